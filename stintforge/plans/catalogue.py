"""The feature catalogue: what each column of the products means, and the document made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintforge.plans.registry import query
from stintforge.plans.relational import conditional_sql, counter_sql, masks
from stintforge.plans.scalar import COMBINATIONS, RATIOS, combined_sql, padded_sql
from stintforge.sources.tables import Tables

COLUMNS = ("name", "meaning", "formula", "unit", "scale", "family")
#: Columns that are not generated from a table of masks.
PLAIN = (
    ("poss", "possessions played", "sum(poss)", "possessions", "a season", "exposure"),
    ("games", "games played", "count(distinct game)", "games", "a season", "exposure"),
    ("pts", "points while on the court", "sum(pts)", "points", "a season", "exposure"),
    ("rate", "points a possession", "sum(pts) / sum(poss)", "points", "a possession", "rating"),
    ("rating", "ridge coefficient of a player among those he played with", "(Z'WZ + k I) b = Z'Wy", "points", "a possession", "rating"),
    ("prior", "rating that a player's own counts predict", "x b, b of the other seasons", "points", "a possession", "rating"),
    ("sd", "spread of a coefficient", "sqrt(diag((Z'WZ + k I)^-1))", "points", "a possession", "rating"),
    ("offense", "points above the season's level", "(pts / poss - level) / 100", "points", "100 possessions", "wins"),
    ("defense", "losses forced above the season's level", "(lost / poss - level) * 10", "points", "100 possessions", "wins"),
    ("pace", "possessions a game above the season's level", "poss / games - level", "possessions", "a game", "wins"),
    ("points", "points added", "(offense + defense) * poss / 100", "points", "a season", "wins"),
    ("wins", "wins added", "points / 30", "wins", "a season", "wins"),
    ("wins_above_bar", "wins above a replaceable player", "wins with 2 points more", "wins", "a season", "wins"),
    ("leverage", "share of possessions late in games", "late / poss", "share", "0 to 1", "wins"),
    ("wins_late", "wins weighed by leverage", "wins * (0.5 + leverage)", "wins", "a season", "wins"),
)


def catalogue() -> list[tuple[str, ...]]:
    """Every feature once, by family and name."""
    told = lambda k: k.replace("_", " ")
    rows = list(PLAIN)
    rows += [(k, f"{told(k)}, a linear combination of counts", combined_sql(w), "points", "100 possessions", "combination") for k, w in COMBINATIONS.items()]
    rows += [(k, f"{told(k)}: {part} among {whole}, padded", padded_sql(part, whole, pad, prior), "share", "0 to 1", "ratio") for k, (part, whole, pad, prior) in RATIOS.items()]
    rows += [(f"stint_{k}", f"{told(k)} of a side in a game", agg, "count", "a game", "counter") for k, agg in counter_sql().items()]
    rows += [(f"box_{k}", f"lines where {m}", f"count(*) filter (where {m})", "count", "a season", "count") for k, m in conditional_sql().items()]
    rows += [(f"{where}_{k}", f"lines where {m}, with the player {where} the court", "(100 c + 200) / (poss + 100)", "count", "100 possessions", "on and off") for k, m in masks().items() for where in ("on", "off")]
    return sorted(rows, key=lambda x: (x[5], x[0]))


def glossary() -> list[str]:
    """The catalogue as lines of a Markdown document, a table a family."""
    out = ["# Features"]
    family = None
    for row in catalogue():
        if row[5] != family:
            family = row[5]
            out += ["", f"## {family}", "", "| name | meaning | formula | unit | scale |", "|-|-|-|-|-|"]
        out.append("| " + " | ".join(x.replace("|", "\\|") for x in row[:5]) + " |")
    return out


@query("cmd15_catalogue")
def _(t: Tables) -> DataFrame:
    """One row a feature: name, meaning, formula, unit, scale, family."""
    return t.spark.createDataFrame(catalogue(), T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS]))


@query("cmd13_glossary")
def _(t: Tables) -> DataFrame:
    """The document's lines, numbered."""
    return t.spark.createDataFrame(list(enumerate(glossary(), 1)), "number long, line string").select("number", F.col("line"))
