"""Links: clusters, cuts and unions on small fixtures; sources and streams."""

import json

from pyspark.sql import functions as F

from factloom.operators import hypotheses as H
from factloom.operators import links as L

COLS = "link_id long, hypothesis_id string, channel string, url string, canonical_url string, title string, snippet string, is_short_video boolean, view_count long, like_count long, comment_count long, share_count long, duration_sec int, creator string, discovered_at timestamp, verdict string, confidence double"


def link(i, url, title="a title that is long enough", hyp="h", channel="news", views=None, short=False, likes=None, comments=None, snippet=None):
    return (i, hyp, channel, url, None, title, snippet, short, views, likes, comments, None, None, None, None, None, None)


def test_clusters_merge_urls_and_texts(spark):
    rows = [link(1, "https://a.com/x?utm_source=1"), link(2, "https://www.a.com/x", channel="reddit"), link(3, "https://b.com/y", views=9, channel="quora"), link(4, "https://c.com/z", "other words entirely here"), link(5, None, "x"), link(6, "", "x")]
    df = spark.createDataFrame(rows, COLS)
    got = {r.link_id: r.representative for r in L.clusters(df).collect()}
    # views count for short videos only, and links without a url share a bucket
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    found = {r.representative: r.also_found_on for r in L.also_found_on(L.clusters(df), df).collect()}
    assert found == {1: "reddit,quora"}
    assert L.clusters(df.limit(0)).count() == 0


def test_balanced_cut_is_a_round_robin(spark):
    rows = [link(i, f"https://a.com/{i}", channel="abc"[i % 3] if i < 9 else "a") for i in range(30)]
    got = [r.link_id for r in L.balanced_cut(spark.createDataFrame(rows, COLS), 12).orderBy("cut_pos").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_short_videos_rank_by_engagement(spark):
    rows = [link(1, "u1", short=True, views=100, likes=1), link(2, "u2", short=True, views=100, likes=50), link(3, "u3", short=True)]
    assert [r.link_id for r in L.channel_ranks(spark.createDataFrame(rows, COLS)).orderBy("rank_in_channel").collect()] == [2, 1, 3]


def test_fallback_union_stops(spark):
    rows = [(1, "h", "u1", "a"), (2, "h", "u2", "a"), (3, "h", "u1", "b"), (4, "h", "u3", "b"), (5, "h", "u4", "c"), (6, "h", None, "a")]
    df = spark.createDataFrame(rows, "link_id long, hypothesis_id string, url string, backend string")
    assert {r.link_id for r in L.fallback_union(df, ["a", "b", "c"], 4).collect()} == {1, 2, 4, 6}
    assert {r.link_id for r in L.fallback_union(df, ["a", "b", "c"], 3).collect()} == {1, 2, 6}


def test_url_rollup_takes_the_first_of_equal_votes(spark):
    rows = [(*link(1, "https://a.com/x")[:-2], "refutes", 0.1), (*link(2, "https://a.com/x#f", hyp="k")[:-2], "supports", 0.9)]
    got = L.url_rollup(spark.createDataFrame(rows, COLS)).collect()
    assert [(r.n_hypotheses, r.n_links, r.confidence_max, r.verdict_majority) for r in got] == [(2, 2, 0.9, "refutes")]


def test_score_channels(spark):
    hyp = spark.createDataFrame([("h", "price", "f1")], "hypothesis_id string, dimension string, force_assignment string")
    w = spark.createDataFrame([("price", "a", 0, 80.0, 81.25), ("price", "b", 1, 80.0, 81.25), ("price", "c", 2, 10.0, 20.0), ("price", "d", 3, 99.0, 99.0)], "dimension string, channel string, channel_ord int, affinity double, base double")
    out = spark.createDataFrame([("f1", "d")], "force_assignment string, channel string")
    assert [(r.channel, r.score) for r in H.score_channels(hyp, w, out).orderBy("place").collect()] == [("a", 80), ("b", 80)]


def test_sources(spark, tmp_path):
    from factloom.sources import files

    (tmp_path / "h.csv").write_text('﻿Statement,ID,Signals\n"one, two",h1,a|b\nthree,,c\n,,\nfour,h1,d\n', encoding="utf-8")
    got = {r.hypothesis_id: (r.statement, r.expected_signals, r.core_problem_id) for r in files.read_hypothesis_csv(spark, str(tmp_path / "h.csv")).collect()}
    assert got == {"h1": ("one, two", ["a", "b"], "_uncategorized"), "h_auto_001": ("three", ["c"], "_uncategorized")}
    (tmp_path / "m.json").write_text(json.dumps({"bundle_id": "b", "hypotheses": {"core_problems": [{"id": "p", "statement": "s", "hypotheses": [{"statement": "x"}, {"statement": " "}, {"hypothesis_id": "k", "statement": "y"}]}]}}))
    assert {r.hypothesis_id for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()} == {"h_auto_001", "k"}
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"url": "u", "title": "t"}\n')
    spark.dataSource.register(files.ReplaySource)
    assert spark.read.format("replay").load(str(folder)).collect()[0].url == "u"


def test_streams(spark, tmp_path):
    from factloom.streaming import events as S

    rows = [(1, "2024-01-01 00:00:00", 7, "error"), (2, "2024-01-01 00:01:00", 7, "error"), (3, "2024-01-01 00:02:00", 8, "error"), (4, "2024-01-01 00:03:00", 8, "click")]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make, mode in (("health", S.source_health, "update"), ("progress", S.progress, "complete")):
        q = make(S.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert {(r.user_id, r.failures, r.cooldown) for r in spark.table("health").collect()} == {(7, 2, 120), (8, 0, 0)}
    assert {(r.event_type, r.n) for r in spark.table("progress").collect()} == {("error", 3), ("click", 1)}
    assert [S.cooldown(n) for n in (0, 1, 2, 3, 30)] == [0, 60, 120, 240, 3600]
