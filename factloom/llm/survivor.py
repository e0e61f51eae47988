"""Best representative of each duplicate group: Bayesian fusion with copy detection, with trust in the sources as prior where it is given."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, need

#: Stand-ins for a missing value, compared in lower case without surrounding blanks.
STAND_INS = (
    "null", "none", "nan", "nil", "n/a", "n.a.", "na", "unknown", "untitled", "undefined", "not available", "(not available)",
    "tbd", "tba", "[deleted]", "[removed]", "deleted", "removed", "missing", "empty", "no title", "unspecified", "not set",
)


def real_text(text: Column) -> Column:
    """Whether a text is a value: not null, not blank, not mere punctuation, not a stand-in."""
    bare = F.regexp_replace(F.lower(text), r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")
    return F.coalesce(bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(*STAND_INS), F.lit(False))


def real_count(n: Column) -> Column:
    return F.coalesce(n >= 0, F.lit(False))


def backend_key(backend: Column) -> Column:
    """One spelling per backend: trimmed, lower case, blanks and dashes as underscores; null if blank."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(backend), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\-]+", "_"), F.lit(""))


def members_of(clusters: DataFrame) -> DataFrame:
    """(cluster_key, link_id) of every cluster with at least two distinct members; null and repeated members count once or not at all."""
    need(clusters, ["cluster_key", "members"])
    ids = F.filter(F.array_distinct("members"), lambda m: m.isNotNull())
    return clusters.select("cluster_key", ids.alias("m")).where(F.size("m") >= 2).select("cluster_key", F.explode("m").alias("link_id")).where("cluster_key is not null")


MAX_TRUST = 10_000


FIELDS = ("title", "snippet", "creator", "view_count")


def survivors(clusters: DataFrame, links: DataFrame, trust: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(cluster_key, field_name, link_id): the member whose value survives in each field, by fusion with trust as its prior.

    Best trust rank first (missing or unlisted backends last), then the latest observed_at (missing last), then the smallest link_id.
    Cases as in ``fuse``; a cluster row repeated with the same key counts as one cluster, and so does a link id given twice.
    """
    return fuse(clusters, links, fields, trust).select("cluster_key", "field_name", "link_id")


def claims_of(clusters: DataFrame, links: DataFrame, fields: Sequence[str] = FIELDS, ranks: DataFrame | None = None) -> DataFrame:
    """What each source says now: (cluster_key, claims), claims holding for each source with a member in the cluster its latest real value
    of every field, as a struct (seen, neg, value) of microseconds, minus the link id and a hash of the value, or null.

    Texts are compared by their lower-case letters and digits. A source is a backend, a missing one being '?'; with ``ranks``
    (_b, trust_rank) it is a rank of trust, all backends without one being the last. Members fall together by source before they meet by cluster, so a cluster's
    array is bounded by the number of sources whatever its size. Later claims of a source replace its earlier ones, ties go to the smaller link id."""
    kinds = dict(links.dtypes)

    def value(c: str) -> Column:
        if kinds[c] == "string":
            return F.when(real_text(F.col(c)), F.xxhash64(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")))
        return F.when(real_count(F.col(c)), F.xxhash64(F.col(c).cast("string")))

    slim = links.select("link_id", F.coalesce(F.unix_micros("observed_at"), F.lit(-(2**62))).alias("seen"), backend_key(F.col("backend_used")).alias("_b"), *[value(c).alias(f"v_{c}") for c in fields])
    if ranks is None:
        slim = slim.withColumn("source", F.coalesce("_b", F.lit("?")))
    else:
        slim = slim.join(ranks, "_b", "left").withColumn("source", F.lpad(F.coalesce("trust_rank", F.lit(2**31 - 1)).cast("string"), 10, "0")).drop("trust_rank")
    latest = [F.max(F.when(F.col(f"v_{c}").isNotNull(), F.struct("seen", (-F.col("link_id")).alias("neg"), F.col(f"v_{c}").alias("value")))).alias(c) for c in fields]
    per = members_of(clusters).join(slim.drop("_b"), "link_id").groupBy("cluster_key", "source").agg(*latest)
    return per.groupBy("cluster_key").agg(F.collect_list(F.struct("source", *fields)).alias("claims"))


def dependence(a: float, b: float, kt: float, kf: float, kd: float, n_false: int, copy_rate: float, prior: float = 0.1) -> float:
    """Posterior chance that one of two sources of accuracies a and b copies the other, from
    the numbers of shared true, shared false and differing values."""
    true, false = a * b, (1 - a) * (1 - b) / n_false
    score = math.log(prior / (1 - prior)) + kd * math.log(1 - copy_rate)
    score += kt * math.log((b * copy_rate + true * (1 - copy_rate)) / true)
    score += kf * math.log(((1 - b) * copy_rate + false * (1 - copy_rate)) / false)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))


def _entries(field: str, place: Column, vote: Column) -> Column:
    """The claims on a field as structs, in order of the sources' places."""
    named = F.transform(F.filter("claims", lambda x: x[field].isNotNull()), lambda x: F.struct(place[x["source"]].alias("place"), x["source"].alias("source"), vote[x["source"]].alias("vote"), x[field]["value"].alias("value"), x[field]["neg"].alias("neg"), x[field]["seen"].alias("seen")))
    return F.array_sort(named)


def _scored(entries: Column, depends: Column, copy_rate: float) -> Column:
    """(value, score, at) of each value: the sum of its sources' votes, each discounted by the chance that it copies an earlier one; ``at`` is its first entry."""

    def free(x: Column) -> Column:
        # an earlier entry with the same value may be what x was copied from
        return F.aggregate(F.filter(entries, lambda y: (y["value"] == x["value"]) & (y["place"] < x["place"])), F.lit(1.0), lambda acc, y: acc * (1 - copy_rate * F.coalesce(F.try_element_at(depends, F.concat_ws("\u0001", x["source"], y["source"])), F.lit(0.0))))

    weighed = F.transform(entries, lambda x: F.struct(x["value"].alias("value"), (x["vote"] * free(x)).alias("w")))
    values = F.array_distinct(F.transform(entries, lambda x: x["value"]))
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.aggregate(F.filter(weighed, lambda e: e["value"] == v), F.lit(0.0), lambda acc, e: acc + e["w"]).alias("score"), F.filter(entries, lambda e: e["value"] == v)[0].alias("at")))


def fuse(
    clusters: DataFrame, links: DataFrame, fields: Sequence[str] = FIELDS, trust: DataFrame | None = None, rounds: int = 3, n_false: int = 10, copy_rate: float = 0.8, max_sources: int = 1000
) -> DataFrame:
    """Bayesian fusion with copy detection: the maximum-posterior value of each field.

    Out: (cluster_key, field_name, link_id, posterior, n_sources, n_values); link_id is the member by which the first source of the value
    claims it. Each round (1) scores a value by the log-odds of the sources that claim it, each discounted by the chance that it
    copied a more accurate source with the same value, (2) turns scores into posteriors, (3) re-estimates source accuracies as mean posteriors and
    the dependence of each pair of sources from the false values they share (``n_false`` false values per true one, ``copy_rate`` is the share of
    values a copier copies).

    ``trust`` (backend, trust_rank) is the prior: sources are then the ranks of trust, and the prior log-odds of each rank exceed
    all that lower ranks can bring together, votes and prior alike. The posterior's maximum thus is what the best rank says, by its latest claim, and what
    the data say on accuracy and copying decides between nothing else. Without it all sources start alike.

    Clusters need two distinct members; null members, members not in ``links``, fields without a real value, and null keys give no row. The claims
    are written once; a round is one pass over them without a shuffle, and sums by source and pair of sources. ``max_sources`` bounds those sums
    and is checked.
    """
    ranks = None
    if trust is not None:
        ranks = trust.groupBy(backend_key(F.col("backend")).alias("_b")).agg(F.min("trust_rank").alias("trust_rank")).where("_b is not null")
        ranks = F.broadcast(ranks) if trust.limit(MAX_TRUST + 1).count() <= MAX_TRUST else ranks
    claims = cut(claims_of(clusters, links, fields, ranks))
    names = sorted(r[0] for r in claims.select(F.explode("claims.source").alias("s")).distinct().limit(max_sources + 1).collect())
    if len(names) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources, or give their ranks of trust")
    accuracy = dict.fromkeys(names, 0.8)
    # a rank's prior outweighs all lower ones: 28 * 3**m, as a vote is within 7 either way
    prior = {s: 28.0 * 3.0 ** min(600, len(names) - 1 - i) if trust is not None else 0.0 for i, s in enumerate(names)}
    depends: dict[tuple[str, str], float] = {}
    literal = lambda d: F.create_map(*[F.lit(x) for kv in (d or {"": 0.0}).items() for x in kv])
    for turn in range(rounds):
        order = sorted(names, key=lambda s: (-prior[s], -accuracy[s], s))
        vote = {s: prior[s] + max(-7.0, min(7.0, math.log(n_false * accuracy[s] / (1 - accuracy[s])))) for s in names}
        place, votes = literal({s: i for i, s in enumerate(order)} or {"": 0}), literal(vote)
        dep = literal({f"{a}\u0001{b}": p for (a, b), p in depends.items() if p > 0.01})
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), _entries(c, place, votes).alias("e")) for c in fields]))
        found = claims.select("cluster_key", pairs.alias("p")).select("cluster_key", "p.*").where(F.size("e") > 0)
        scored = found.withColumn("v", _scored(F.col("e"), dep, copy_rate)).withColumn("top", F.array_max(F.transform("v", lambda x: x["score"])))
        scored = scored.withColumn("total", F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.exp(x["score"] - F.col("top"))))
        if turn + 1 == rounds:
            break
        said = scored.select("e", F.map_from_entries(F.transform("v", lambda x: F.struct(x["value"], F.exp(x["score"] - F.col("top")) / F.col("total")))).alias("p"))
        stats = said.select(F.explode("e").alias("e"), "p").groupBy("e.source").agg(F.avg(F.col("p")[F.col("e.value")]).alias("a")).collect()
        accuracy |= {r["source"]: min(0.99, max(0.05, r["a"])) for r in stats}
        # pairs of sources on an item: a source has one entry, so they are bounded by the sources
        both = said.select(F.explode(F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: a["source"] < b["source"]), lambda b: F.struct(
            a["source"].alias("a"), b["source"].alias("b"), (a["value"] == b["value"]).alias("same"), F.col("p")[a["value"]].alias("p")))))).alias("x")).select("x.*")
        counts = both.groupBy("a", "b").agg(F.sum(F.when(F.col("same"), F.col("p")).otherwise(0.0)).alias("kt"), F.sum(F.when(F.col("same"), 1 - F.col("p")).otherwise(0.0)).alias("kf"), F.count_if(~F.col("same")).alias("kd"))
        depends = {}
        for a, b, kt, kf, kd in counts.collect():
            depends[a, b] = depends[b, a] = dependence(accuracy[a], accuracy[b], kt, kf, kd, n_false, copy_rate)
    best = F.array_max(F.transform("v", lambda x: F.struct(x["score"], x["at"]["seen"], x["at"]["neg"])))
    return scored.withColumn("b", best).select(
        "cluster_key", "field_name", (-F.col("b.neg")).alias("link_id"), F.round(1 / F.col("total"), 6).alias("posterior"), F.size("e").alias("n_sources"), F.size("v").alias("n_values")
    )
