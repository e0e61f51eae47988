"""Clusters, ranks, state, manifests, model answers and exports on small and odd inputs."""

import os

import pytest
from pyspark.sql import functions as F

from factloom import session as S
from factloom.operators import hypotheses as H
from factloom.operators import links as L
from factloom.operators import manifest as M
from factloom.operators import model, packed, state
from factloom.plans import export
from factloom.sources import replay

LINK = "link_id long, hypothesis_id string, url string, canonical_url string, title string, snippet string, channel string, is_short_video boolean, view_count long, discovered_at timestamp"


def test_big_rank_equals_a_window(spark):
    rows = [(i, "hot" if i % 4 else f"k{i % 7}" if i % 3 else None, (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v int")
    got = {r.id: r.n for r in S.big_rank(df, ["k"], [F.col("v"), F.col("id")], "n").collect()}
    groups: dict = {}
    for i, k, v in rows:
        groups.setdefault(k, []).append((v, i))
    want = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert got == want and S.big_rank(df.limit(0), ["k"], [F.col("v")], "n").count() == 0


def test_clusters(spark):
    long = "a title that is long enough to be hashed"
    rows = [
        (1, "h", "https://a.example/x?utm_source=1", None, "t", None, "web", False, None, None), (2, "h", "https://other.example", "https://A.example/x", "u", None, "forum", None, None, None),
        (3, "h", "https://b.example/1", "", long, "same", "web", False, 9, None), (4, "h", "https://c.example/2", None, long.upper(), "Same", "shorts", True, 1, None), (5, "i", "https://a.example/x", None, None, None, "web", False, None, None),
    ]
    videos = spark.createDataFrame([(4, "same", None, ["c"]), (9, None, "t", [])], "link_id long, caption string, transcript string, top_comments array<string>")
    df = spark.createDataFrame(rows, LINK)
    got = {r.link_id: r.representative for r in L.clusters(df, videos=videos).collect()}
    assert got == {1: 1, 2: 1, 3: 4, 4: 4, 5: 5}  # a short video stands for its cluster; hypotheses stay apart
    also = {r.representative: r.also_found_on for r in L.also_found_on(L.clusters(df, videos=videos), df).collect()}
    assert also == {1: "forum", 4: "web"}
    assert L.clusters(df.limit(0), videos=videos).count() == 0


def test_hosts_and_picks(spark):
    df = spark.createDataFrame([(1, "h", "a.example"), (2, "h", "x.a.example"), (3, "h", "xa.example"), (4, "h", None), (5, "h", "forum.b.example")], "link_id long, hypothesis_id string, host string")
    rules = [("a.example", "suffix", 1), ("forum", "part", 5)]
    assert sorted((r.link_id, r.pattern) for r in L.host_matches(df, rules).collect()) == [(1, "a.example"), (2, "a.example"), (5, "forum")]
    assert sorted(r.link_id for r in L.pool_pick(df, rules).collect()) == [1, 5]


def test_source_states(spark):
    rows = [("a", 1, 1, "captcha_cooldown", 60), ("a", 2, 2, "captcha_cooldown", 60), ("a", 3, 3, "missing_key", 0), ("b", 1, 4, "rate_limited", 60), ("b", 2, 5, "ok", 0), ("c", 1, 6, "unavailable", None), ("d", 1, 7, "rate_limited", 60), ("d", 2, 8, "unavailable", 0)]
    df = spark.createDataFrame(rows, "source string, t long, seq long, status string, base_seconds int").withColumn("at", F.timestamp_seconds("t"))
    got = {r.source: (r.status, r.failures, r.cooldown, r.until) for r in state.source_states(df).collect()}
    assert got == {"a": ("missing_key", 2, 120, 122_000_000), "b": ("ok", 0, None, None), "c": ("unavailable", 1, None, None), "d": ("unavailable", 2, 60, 61_000_000)}
    assert state.source_states(df.limit(0)).count() == 0


def test_job_and_batch_states(spark):
    rows = [(1, 1, 1, "log"), (2, 1, 2, "start"), (3, 1, 3, "start"), (3, 2, 4, "error"), (3, 3, 5, "done")]
    df = spark.createDataFrame(rows, "job long, t long, seq long, kind string").withColumn("at", F.timestamp_seconds("t"))
    assert {r.job: r.status for r in state.job_states(df).collect()} == {1: "pending", 2: "running", 3: "error"}
    members = spark.createDataFrame([("x", "done"), ("x", "error"), ("y", "done"), ("z", "error"), ("w", "queued")], "batch string, status string")
    assert {r.batch: r.status for r in state.batch_states(members).collect()} == {"x": "partial", "y": "done", "z": "error", "w": "done"}


def test_providers(spark):
    df = spark.createDataFrame([(1, "p"), (2, None), (3, "fail")], "id int, prompt string")
    assert [r.answer for r in model.ask(df, "prompt").collect()] == [None] * 3

    def provider(prompts):
        if "fail" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    assert {r.id: r.answer for r in model.ask(df, "prompt", provider, batch=1).collect()} == {1: "P", 2: None, 3: None}


def test_manifest_texts_and_decomposition(spark):
    df = spark.createDataFrame([(1, "Rivals are Acme, Bolt and in the end nobody"), (2, None), (3, "")], "id int, t string")
    assert {r.id: r.c for r in df.select("id", M.competitors(F.col("t")).alias("c")).collect()} == {1: ["Acme", "Bolt"], 2: [], 3: []}
    hyp = spark.createDataFrame([("h", "Kestoro Labs loses to Wexonia", None, None, "a|b")], "hypothesis_id string, statement string, rationale string, core_problem_statement string, expected_signals string")
    own, merged = H.decompose(hyp).first(), H.decompose(hyp, {"brand": "Wexonia", "competitors": ["Acme"], "geo": ["india"]}).first()
    assert own.primary_entity == "Kestoro Labs" and own.competitors == ["Wexonia"] and own.signals == ["a", "b"]
    assert merged.primary_entity == "Wexonia" and merged.competitors == ["Acme"] and merged.places == ["india"]


def test_trends(spark):
    df = spark.createDataFrame([(1, '[{"query": " Tea ", "value": "5"}, {"query": "tea", "value": "9", "kind": "rising"}, {"query": "x"}]'), (2, "bad"), (3, None)], "id int, payload string")
    assert [(r.id, r.query, r.kind, r.value) for r in replay.trends(df).collect()] == [(1, "Tea", "top", 5)]


def test_exports(spark, tmp_path):
    path = str(tmp_path / "out")
    export.write_csv(spark.createDataFrame([(1, "é")], "k long, s string"), path)
    text = next(open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path) if f.endswith(".csv"))
    assert text.startswith("﻿k,s")
    table = str(tmp_path / "table")
    for n in (1, 3):
        export.snapshot(spark.range(n), table)
        assert spark.read.parquet(table).count() == n
    assert os.listdir(tmp_path) and not [f for f in os.listdir(tmp_path) if ".new-" in f or ".old-" in f]


@pytest.mark.parametrize("text, values", [("a；b", ["a", "b"]), ("a ¦ b", ["a", "b"]), ("a • b, c", ["a", "b, c"]), ("a / b", ["a", "b"]), ("w/o a, b", ["w/o a", "b"]), ('"x；y"；z', ["x；y", "z"]), ("/ ", ["/"])])
def test_other_separators(text, values):
    assert packed.split_values(text) == values
