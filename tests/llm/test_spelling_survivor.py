"""Canonical duplicates and survivors: equality rules, hot groups, odd tables, SQL on the smallest data."""

import itertools

import pytest
from conftest import DATA, rows_of

from factloom.llm import oracles, queries, spelling, survivor

LINK = "link_id long, url string, title string, snippet string"


def copies(spark, rows, **kw):
    keys = spelling.record_keys(spark.createDataFrame(rows, LINK), "link_id", ["title", "snippet"], ["url"])
    return sorted((r.keep_id, r.copy_id) for r in spelling.copies(keys, **kw).collect())


def test_what_counts_as_equal(spark):
    base = ("https://a.example/p/x-y?b=2&a=1", "The Title", "It is, well, here.")
    same = [("HTTPS://A.example/p/x%2Dy/?a=1&b=2", "the title!!", "it is well here"), ("https://a.example/p/x y?&a=1&b=2", "**The­Title** ", "[It is – well here]​"), base]
    other = [("https://a.example/p/x-y?b=1&a=2", *base[1:]), (base[0], "The Title twice", base[2]), (base[0] + "#part", *base[1:]), ("https://a.example/p/x-y?b=2%26a=1", *base[1:]), (None, None, None)]
    rows = [(i, *r) for i, r in enumerate([base, *same, *other])]
    assert copies(spark, rows) == [(0, 1), (0, 2), (0, 3)]


def test_hot_record_nulls_and_empty(spark):
    hot = [(i, "u", "t", "s") for i in range(200)] + [(200 + i, f"u{i // 2}x", "t", None) for i in range(40)] + [(None, "u", "t", "s"), (300, "", " ", None), (301, None, "!", "")]
    got = copies(spark, hot, hot_share=4)
    assert got == sorted([(0, i) for i in range(1, 200)] + [(200 + i, 201 + i) for i in range(0, 40, 2)] + [(300, 301)])
    assert copies(spark, []) == []
    keys = spelling.record_keys(spark.createDataFrame([(1, "u", "t" * 300_000, "s", 5)], LINK + ", h128 int"), "link_id", ["title", "snippet"], ["url"])
    groups = spelling.collapse(keys)
    assert groups.first().n_copies == 1 and spelling.collisions(groups).count() == 0


FULL = "link_id long, backend_used string, observed_at timestamp, title string, snippet string, creator string, view_count long"


def test_survivors_follow_the_order(spark):
    from datetime import datetime as D

    a, b = D(2024, 1, 1), D(2024, 2, 1)
    rows = [(1, "Slow", b, "x", None, "null", -1), (2, " fast", a, "n/a", "s", "-", 0), (3, "FAST", b, "y", " ", None, None), (4, "fast", b, "z", None, "Untitled", 7), (5, None, b, "q", "s2", "me", 9)]
    links = spark.createDataFrame(rows, FULL)
    trust = spark.createDataFrame([("fast", 1), ("slow", 2)], "backend string, trust_rank int")
    clusters = spark.createDataFrame([(10, [5, 4, 3, 2, 1, 1]), (11, [1, 1]), (12, [3, None, 99]), (13, None), (None, [1, 2])], "cluster_key long, members array<long>")
    got = sorted(tuple(r) for r in survivor.survivors(clusters, links, trust).collect())
    assert got == [(10, "creator", 5), (10, "snippet", 2), (10, "title", 3), (10, "view_count", 4), (12, "title", 3)]
    assert survivor.survivors(clusters.limit(0), links, trust).count() == 0


def test_fusion_discounts_copied_votes(spark):
    rows, clusters, n = [], [], 0
    truth = itertools.cycle("ab")
    for k in range(40):
        t = next(truth)
        wrong = f"w{k}"
        # a and b are right on their own; c and d share one wrong value in half of the cases
        says = {"a": f"{t}{k}", "b": f"{t}{k}", "c": wrong if k % 2 else f"{t}{k}", "d": wrong if k % 2 else f"{t}{k}", "e": wrong if k % 2 else f"{t}{k}"}
        if k > 20:
            says.pop("b")
        ids = []
        for s, v in says.items():
            rows.append((n, s, None, v, None, None, None))
            ids.append(n)
            n += 1
        clusters.append((k, ids))
    links, cl = spark.createDataFrame(rows, FULL), spark.createDataFrame(clusters, "cluster_key long, members array<long>")
    got = survivor.fuse(cl, links, ("title",), rounds=3).collect()
    assert len(got) == 40 and all(0 < r.posterior <= 1 for r in got)
    assert survivor.dependence(0.8, 0.8, 5, 10, 0, 10, 0.8) > 0.9 > 0.2 > survivor.dependence(0.8, 0.8, 10, 0, 10, 10, 0.8)
    assert survivor.fuse(cl.limit(0), links, ("title",)).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.execute(oracles.ORACLES[name])
    columns = [x[0] for x in found.description]
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(found.fetchall(), columns)
