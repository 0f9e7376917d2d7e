"""The command line: what each command runs, and what it writes."""

import pytest

from stintforge import __main__ as cli
from stintforge.plans import catalogue, registry

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("words", [[c] for c in cli.COMMANDS] + [["data", s] for s in cli.STEPS])
def test_every_command_has_queries(words):
    given = cli.parser().parse_args([*words, ROOT])
    names = cli.chosen(given)
    begins = (cli.STEPS[words[1]] if words[0] == "data" else cli.COMMANDS[words[0]])[1]
    assert {n.split("_")[0] for n in names} == set(begins) and set(names) <= set(registry.queries())


def test_results_are_written_and_cut_to_seasons(spark, tmp_path):
    assert cli.main(["data", "hustle", ROOT, "--out", str(tmp_path)]) == 0
    assert spark.read.parquet(f"{tmp_path}/agg28_conditional_counts").count() > 0
    assert cli.main(["run", ROOT, "cmd09_wins_columns", "--out", str(tmp_path), "--format", "json", "--seasons", "1995-1996,1998"]) == 0
    assert {r.season for r in spark.read.json(f"{tmp_path}/cmd09_wins_columns").select("season").distinct().collect()} == {1995, 1996, 1998}


def test_unknown_words_are_errors(capsys):
    for words in (["nothing"], ["data", "nothing", ROOT], ["run", ROOT, "no_such_query"], ["wins"], ["rate", ROOT, "--format", "xml"]):
        with pytest.raises(SystemExit):
            cli.main(words)


def test_list_names_all(capsys):
    assert cli.main(["list"]) == 0
    assert capsys.readouterr().out.split() == sorted(registry.queries())


def test_glossary_is_written_and_checked(tmp_path):
    file = str(tmp_path / "features.md")
    assert cli.main(["glossary", "--out", file, "--check"]) == 1
    assert cli.main(["glossary", "--out", file]) == 0 and cli.main(["glossary", "--out", file, "--check"]) == 0
    text = open(file).read()
    rows = catalogue.catalogue()
    assert len({r[0] for r in rows}) == len(rows) > 100 and all(all(r) for r in rows)
    assert sum(line.startswith("| ") for line in text.split("\n")) == len(rows) + len({r[5] for r in rows})
