"""Tables that steps leave behind, and rounds that known groups do not take."""

from pathlib import Path

import pytest

import corpus_pipeline
from tallyframe.llm import common
from tallyframe.llm.common import components
from tallyframe.workspace import passing, settle, shared_dir

SF = "/root/testdata/sf0.001"


def test_groups_that_are_known_take_no_round(spark, monkeypatch):
    made = []

    def counted(df, name="settled", keep=False):
        made.append(name)
        return settle(df, name, keep)

    monkeypatch.setattr(common, "settle", counted)
    groups = components(spark.createDataFrame([(n, n + 1) for n in range(50)] + [(90, 80)], "a long, b long"))
    rounds = made.count("edges")
    assert rounds > 1
    again = components(common.stars(groups).unionByName(spark.createDataFrame([(60, 90)], "a long, b long")))
    assert {r["node"]: r["component"] for r in again.collect()} == {**{n: 0 for n in range(51)}, 60: 60, 80: 60, 90: 60}
    made.clear()
    assert sorted(components(common.stars(again)).collect()) == sorted(again.collect())
    assert made == ["edges", "least", "components"]


def test_the_near_copies_of_the_pipeline_leave_one_narrow_table(spark):
    folder = Path(shared_dir(spark))
    before = set(folder.glob("tallyframe/*/*"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.near_copies(spark, docs, SF)
    left = [p for p in folder.glob("tallyframe/*/*") if p not in before]
    assert [p.name.rsplit("-", 1)[0] for p in left] == ["kept"]
    assert rows.count() == spark.read.parquet(str(left[0])).count()


def _path(url):
    return Path("/" + url.split(":", 1)[-1].lstrip("/"))


def test_tables_in_passing_go_also_after_a_failure(spark):
    with pytest.raises(ZeroDivisionError):
        with passing(spark):
            with passing(spark):
                gone, kept = settle(spark.range(3)), settle(spark.range(4), keep=True)
                files = gone.inputFiles()
            assert kept.count() == 4 and not any(_path(f).exists() for f in files)
            files = kept.inputFiles()
            1 / 0
    assert files and not any(_path(f).exists() for f in files)
