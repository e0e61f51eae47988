"""Shared helpers: cut tables, salted joins, readable failures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from factloom import session as S
from factloom.plans import export


def test_cut_reads_back(spark):
    df = spark.createDataFrame([(1, ["a"], None), (2, None, "x")], "k long, a array<string>, s string")
    assert sorted(S.cut(df).collect()) == sorted(df.collect())
    assert S.cut(df.limit(0)).schema == df.schema


def test_salted_join_equals_a_plain_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id long, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v long")
    got = sorted(tuple(r) for r in S.salted_join(big, small, "k", F.col("id")).select("id", "k", "v").collect() if r.k)
    want = sorted(tuple(r) for r in big.join(small, "k", "left").select("id", "k", "v").collect() if r.k)
    assert got == want


def test_need_names_the_missing(spark):
    with pytest.raises(ValueError, match="b"):
        S.need(spark.createDataFrame([(1,)], "a long"), ["a", "b"])


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x", "y\nz"], 0.5, True, None)], "k long, a array<string>, d double, b boolean, s string")
    assert tuple(export.flat(df).first()) == ("1", "x | y z", "0.5", "true", "")
    export.write_csv(df, str(tmp_path / "out"))
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "out"))
    page = "".join(r.html for r in export.html_report(spark.createDataFrame([("<b>",)] * 3, "t string")).orderBy("part", "i").collect())
    assert page.count("&lt;b&gt;") == 3 and page.startswith("<!doctype") and page.endswith("</table>")


def test_results_json_holds_every_link(spark):
    verdicts = ["supports", "refutes", "tangential", None, "", "odd"]
    links = [(i, "h1", verdicts[i % 6], i / 100) for i in range(60)] + [(100, "h2", "supports", None), (101, "h2", "supports", 0.5)]
    hyp = [("h1", "cp1", "s1"), ("h2", None, "s2"), ("h3", "cp3", "no links")]
    df = spark.createDataFrame(links, "link_id long, hypothesis_id string, verdict string, confidence double")
    members = spark.createDataFrame(hyp, "hypothesis_id string, core_problem_id string, statement string")
    for chunk, parts in ((1000, 1), (8, 8)):
        rows = export.results_json(df, members, chunk).collect()
        got: dict = {}
        for r in rows:
            out = json.loads(r.result)
            assert out["core_problem_id"] == r.core_problem_id
            for v, found in out["grouped"].items():
                assert [x["confidence"] or 0 for x in found] == sorted((x["confidence"] or 0 for x in found), reverse=True)
                got.setdefault((r.core_problem_id, r.hypothesis_id), {}).setdefault(v, []).extend(x["link_id"] for x in found)
            if r.hypothesis_id == "h1":
                assert out["parts"] == parts and out["verdict_counts"] == {"supports": 10, "refutes": 10, "tangential": 30, "odd": 10}
        assert {v: sorted(x) for v, x in got["cp1", "h1"].items()} == {v: [i for i in range(60) if (verdicts[i % 6] or "tangential") == v] for v in ("supports", "refutes", "tangential", "odd")}
        assert sorted(got["_uncategorized", "h2"]["supports"]) == [100, 101]
        assert got["cp3", "h3"] == {"supports": [], "refutes": [], "tangential": []}
        assert sum(r.hypothesis_id == "h1" for r in rows) == parts
