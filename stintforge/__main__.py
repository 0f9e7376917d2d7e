"""Command line: every step of the work by its own name.

``python -m stintforge COMMAND FOLDER --out FOLDER`` runs a command's queries over a folder of tables and writes each
result into a folder of its own; without ``--out`` the first rows are shown.  ``data STEP`` does the same for the
steps that prepare data, ``run QUERY`` for any one query, ``list`` names them all, and ``glossary`` writes (or, with
``--check``, compares) the document of features.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stintforge.functions.text import season_list
from stintforge.plans import registry

#: Queries of each command, by the beginnings of their names.
COMMANDS = {
    "build": ("ratings of all seasons with their sinks", ("cmd02", "cmd05")),
    "wins": ("wins columns and what they rest on", ("cmd09", "lam63", "lam66", "lam69", "lam70")),
    "rate": ("one season's ratings", ("lam02", "lam56", "lam21")),
    "shrink": ("shrinkage towards team means", ("cmd03", "lam28", "lam29")),
    "swap": ("pairs of lineups that differ by one player", ("cmd04", "joi01", "lam46")),
    "folds": ("held-out folds and their checks", ("cmd06", "src23", "set08")),
    "second": ("equations of the second line", ("cmd08", "lam36", "lam44")),
    "site": ("documents for a site", ("cmd10", "src37", "src38")),
    "compare": ("seasons against their neighbours", ("cmd14", "chk05", "chk06")),
}
STEPS = {
    "ingest": ("logs and boxes that are not there yet", ("src01", "src04", "src05", "src09")), "stints": ("constant segments and possessions", ("win01", "tim13", "agg01")), "progress": ("what is missing", ("src07", "joi25", "set07")),
    "games": ("one row a game", ("src02", "src14")), "events": ("typed events", ("flt01", "flt09")), "careers": ("players over seasons", ("src11", "agg20", "agg60")), "dashboards": ("stacked dashboards", ("src19",)),
    "hustle": ("conditional counts", ("agg28",)), "tracking": ("further counts", ("agg29",)), "matchups": ("pairs of attackers and defenders", ("src22", "joi08")), "panel": ("the season panel", ("agg17", "set10")),
    "public": ("external tables", ("src28", "src29", "src30", "src31", "src32", "src33")),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stintforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def work(where, name: str, told: str) -> argparse.ArgumentParser:
        own = where.add_parser(name, help=told)
        own.add_argument("folder", help="folder of Parquet tables")
        own.add_argument("--out", help="write here instead of showing twenty rows")
        own.add_argument("--format", default="parquet", choices=("parquet", "csv", "json", "orc"))
        own.add_argument("--seasons", type=season_list, help="1995-1997,1999: only rows of these seasons, where a result has seasons")
        return own

    commands.add_parser("list", help="names of all queries")
    work(commands, "run", "one query").add_argument("query")
    for name, (told, _) in COMMANDS.items():
        work(commands, name, told)
    steps = commands.add_parser("data", help="steps that prepare data").add_subparsers(dest="step", required=True)
    for name, (told, _) in STEPS.items():
        work(steps, name, told)
    text = commands.add_parser("glossary", help="the document of features")
    text.add_argument("--out", default="FEATURES.md")
    text.add_argument("--check", action="store_true", help="only tell whether the file is up to date")
    return top


def chosen(given: argparse.Namespace) -> list[str]:
    """The queries a command stands for."""
    known = sorted(registry.queries())
    if given.command == "run":
        if given.query not in known:
            raise SystemExit(f"no query {given.query}")
        return [given.query]
    begins = (STEPS[given.step] if given.command == "data" else COMMANDS[given.command])[1]
    return [q for b in begins for q in known if q.split("_")[0] == b]


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    if given.command == "glossary":
        from stintforge.plans.catalogue import glossary

        text, file = "\n".join(glossary()) + "\n", Path(given.out)
        if given.check:
            return 0 if file.exists() and file.read_text() == text else 1
        file.write_text(text)
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in chosen(given):
        rows = registry.queries()[name](spark, given.folder)
        if given.seasons and "season" in rows.columns:
            rows = rows.where(F.col("season").isin(given.seasons))
        if given.out:
            rows.write.mode("overwrite").format(given.format).save(f"{given.out}/{name}")
        else:
            print(name)
            rows.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
