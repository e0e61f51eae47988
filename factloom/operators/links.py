"""Links: first-wins dedup, clustering, representatives, ranking, cuts and roll-ups.

Order decides many results; ``ord`` is an explicit ordinal (here the link id), never the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import content_hash, engagement
from factloom.functions.urls import canonical_url, strip
from factloom.session import cut


def url_key(canonical: Column, url: Column) -> Column:
    return F.lower(strip(F.coalesce(F.nullif(strip(canonical), F.lit("")), url)))


def first_per(df: DataFrame, keys: list[str], order: str = "link_id") -> DataFrame:
    """The first row of each key, by aggregation: partial minima before the shuffle, so hot keys cost little."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_one"))
    return picked.select(*keys, "_one.*").select(*df.columns)


def first_urls(links: DataFrame, scope: list[str], cap: int | None = None) -> DataFrame:
    """First link of each url within the scope, at most ``cap`` a scope in order of id. Rows without any url are dropped."""
    keyed = links.withColumn("url_key", url_key(F.col("canonical_url"), F.col("url"))).where("url_key <> ''")
    first = first_per(keyed, [*scope, "url_key"])
    if cap is None:
        return first
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy("link_id"))).where(F.col("_n") <= cap).drop("_n")


def fallback_union(links: DataFrame, order: list[str], least: int, scope: str = "hypothesis_id", source: str = "backend") -> DataFrame:
    """Results of backends in priority order, distinct by url, until a backend's predecessors give ``least``.

    Backend k counts while the distinct urls of the backends before it number less than ``least``; urls met before
    count for the earlier backend; rows without a url all stay."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(source)), F.lit(0))
    ranked = links.withColumn("_rank", rank).where("_rank > 0").withColumn("_key", F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.concat(F.lit("\u0000"), F.col("link_id").cast("string"))))
    # the first row of each url in this order
    best = ranked.groupBy(scope, "_key").agg(F.min(F.struct("_rank", "link_id")).alias("b")).select(scope, "b.*")
    counts = best.groupBy(scope, "_rank").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(scope).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    open_ranks = before.where(F.col("before") < least).select(scope, "_rank")
    return best.join(open_ranks, [scope, "_rank"]).select(scope, "link_id", F.col("_rank").alias("backend_rank"))


def with_videos(links: DataFrame, videos: DataFrame | None) -> DataFrame:
    """links with what short videos add to clustering: caption, and how many of comments and transcript there are.

    Videos of one id count once (the greatest caption); without videos the columns are null and 0."""
    if videos is None:
        return links.withColumns({"caption": F.lit(None).cast("string"), "enriched": F.lit(0)})
    there = F.coalesce((F.size("top_comments") > 0).cast("int"), F.lit(0)) + F.coalesce((F.col("transcript") != "").cast("int"), F.lit(0))
    slim = videos.groupBy("link_id").agg(F.max("caption").alias("caption"), F.max(there).alias("enriched"))
    return links.join(slim, "link_id", "left").withColumn("enriched", F.coalesce("enriched", F.lit(0)))


def representative_key() -> Column:
    """What makes a link stand for its cluster: short video; its views and enrichment; then the earlier discovery (a missing one
    counts as the epoch) and the smaller id. Reads the columns of with_videos."""
    short = F.coalesce(F.col("is_short_video"), F.lit(False))
    views = F.when(short, F.coalesce("view_count", F.lit(0))).otherwise(F.lit(0).cast("bigint"))
    enriched = F.when(short, F.col("enriched")).otherwise(F.lit(0))
    early = F.coalesce(-F.unix_micros("discovered_at"), F.lit(0).cast("bigint"))
    return F.struct(short.alias("short"), views.alias("views"), enriched.alias("enriched"), early.alias("early"), (-F.col("link_id")).alias("neg"))


def clusters(links: DataFrame, scope: str = "hypothesis_id", videos: DataFrame | None = None) -> DataFrame:
    """(scope, link_id, cluster, representative, ord): links with one canonical url, or whose url buckets'
    representatives share a content hash, are one cluster.

    The canonical url is that of ``canonical_url``, or of ``url`` where it is missing; links without either share a bucket.
    A bucket has one hash, so groups of buckets are equivalence classes and need no
    search for components; a bucket without a hash stands alone. ``cluster`` names the group and ``ord`` is the order of members:
    by the first link of their bucket, then by id. Every step is an aggregate with partial results, joined back by equality.
    """
    url = F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url"))
    short = F.coalesce(F.col("is_short_video"), F.lit(False))
    body = F.when(short, F.coalesce(F.nullif("caption", F.lit("")), F.col("snippet"))).otherwise(F.col("snippet"))
    base = cut(with_videos(links.select(scope, "link_id", "url", "canonical_url", "title", "snippet", "is_short_video", "view_count", "discovered_at"), videos).select(
        F.coalesce(scope, F.lit("")).alias("scope"), "link_id", F.md5(canonical_url(url)).alias("bucket"), content_hash(F.col("title"), body).alias("hash"), representative_key().alias("key"),
    ))  # fmt: skip — the keys are read twice
    buckets = base.groupBy("scope", "bucket").agg(F.max(F.struct("key", "hash")).alias("top"), F.min("link_id").alias("first"))
    named = buckets.select("scope", "bucket", "first", F.coalesce(F.concat(F.lit("h:"), F.col("top.hash")), F.concat(F.lit("u:"), F.col("bucket"))).alias("cluster"), F.col("top.key").alias("key"))
    heads = named.groupBy("scope", "cluster").agg((-F.max("key")["neg"]).alias("representative"))
    whole = named.select("scope", "bucket", "cluster", "first").join(heads, ["scope", "cluster"])
    joined = base.select("scope", "bucket", "link_id").join(whole, ["scope", "bucket"])
    return joined.select(F.col("scope").alias(scope), "link_id", "cluster", "representative", F.struct("first", "link_id").alias("ord"))


def also_found_on(members: DataFrame, links: DataFrame) -> DataFrame:
    """(representative, also_found_on): the other channels of a cluster in order of their first member, joined by commas."""
    ch = members.join(links.select("link_id", "channel"), "link_id")
    own = ch.where("link_id = representative").select("representative", F.col("channel").alias("own")).distinct()
    first = ch.groupBy("representative", "channel").agg(F.min("ord").alias("ord"))
    other = first.join(own, "representative").where(~F.col("channel").eqNullSafe(F.col("own")) & F.col("channel").isNotNull())
    # at most one entry a channel
    return other.groupBy("representative").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "channel"))), lambda s: s["channel"]), ",").alias("also_found_on"))


def cluster_sizes(members: DataFrame, links: DataFrame, scope: str = "hypothesis_id") -> DataFrame:
    """One row per cluster: its scope, representative, number of links, and number of channels."""
    ch = members.join(links.select("link_id", "channel"), "link_id")
    per = ch.groupBy(scope, "representative", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    return per.groupBy(scope, "representative").agg(F.sum("n").alias("size"), F.count("channel").alias("n_channels"), F.min("ord").alias("ord"))


def channel_ranks(links: DataFrame) -> DataFrame:
    """rank_in_channel within hypothesis and channel: short videos by engagement (null as 0), others first come first served."""
    return links.withColumn("_score", channel_score()).withColumn("rank_in_channel", F.row_number().over(Window.partitionBy("hypothesis_id", "channel").orderBy(F.desc("_score"), "link_id"))).drop("_score")


def channel_score() -> Column:
    """Engagement of short videos (null as 0), 0 for others."""
    return F.when(F.col("is_short_video"), F.coalesce(engagement(F.col("view_count"), F.col("like_count"), F.col("comment_count")), F.lit(0.0))).otherwise(0.0)


def balanced_cut(links: DataFrame, size: int = 30) -> DataFrame:
    """The links that a round robin over a hypothesis's channels (in order of their first link) takes until ``size``.

    Equal to ordering by (rank in channel, first link of the channel). Ranks above ``size``
    fall away first, per task, so a hypothesis that holds a tenth of all rows never meets in one task.
    """
    firsts = links.groupBy("hypothesis_id", "channel").agg(F.min("link_id").alias("_first"))
    top = channel_ranks(links).where(F.col("rank_in_channel") <= size).join(firsts, ["hypothesis_id", "channel"])
    w = Window.partitionBy("hypothesis_id").orderBy("rank_in_channel", "_first")
    return top.withColumn("cut_pos", F.row_number().over(w)).where(F.col("cut_pos") <= size).drop("_first")


VERDICT_ORDER = ("supports", "refutes", "tangential")


def verdict_place(v: Column) -> Column:
    return F.when(v == "supports", 0).when(v == "refutes", 1).otherwise(2)


def url_rollup(links: DataFrame) -> DataFrame:
    """One row per canonical url over all hypotheses: how many, which verdict most often (ties: first seen), the best confidence."""
    keyed = links.select("link_id", "hypothesis_id", "verdict", "confidence", F.md5(canonical_url(F.col("url"))).alias("url_key"), F.coalesce("is_short_video", F.lit(False)).alias("short"), F.coalesce("view_count", F.lit(0)).alias("views"))
    votes = keyed.where("verdict is not null").groupBy("url_key", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("link_id").alias("first"))
    majority = votes.groupBy("url_key").agg(F.max_by("verdict", F.struct("n", (-F.col("first")).alias("f"))).alias("verdict_majority"))
    hyps = keyed.groupBy("url_key", "hypothesis_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.max(F.struct("short", "views", (-F.col("link_id")).alias("neg"))).alias("key"))
    total = hyps.groupBy("url_key").agg(
        F.count("hypothesis_id").alias("n_hypotheses"), F.sum("n").alias("n_links"), F.max("confidence").alias("confidence_max"), (-F.max("key")["neg"]).alias("representative")
    )
    return total.join(majority, "url_key", "left")


def host_matches(links: DataFrame, patterns: list[tuple[str, str, int]]) -> DataFrame:
    """links with a ``host`` once for each (pattern, kind, n) that it matches; the list is a parameter, so no join is needed."""
    tests = [F.when((F.col("host") == p) | F.col("host").endswith("." + p) if kind == "suffix" else F.col("host").contains(p), F.struct(F.lit(p).alias("pattern"), F.lit(n).alias("asked"))) for p, kind, n in patterns]
    return links.withColumn("_m", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))).select("*", "_m.*").drop("_m")


def pool_pick(links: DataFrame, patterns: list[tuple[str, str, int]]) -> DataFrame:
    """The first links of each hypothesis and pattern, as many as the pattern asks; Spark prunes each task to the group's limit first."""
    most = max((n for _, _, n in patterns), default=0)
    w = Window.partitionBy("hypothesis_id", "pattern").orderBy("link_id")
    return host_matches(links, patterns).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).where(F.col("n") <= F.col("asked"))
