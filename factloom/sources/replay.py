"""Payloads of search, video and forum interfaces, replayed from text columns: the parsers that live sources share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import engagement, hashtags, iso_seconds

POST = "struct<permalink:string,title:string,selftext:string,subreddit:string,score:string,num_comments:string,created_utc:double,comments:array<string>>"
VIDEO = "struct<id:string,snippet:struct<title:string,channelTitle:string,publishedAt:string>,contentDetails:struct<duration:string>,statistics:struct<viewCount:string,likeCount:string,commentCount:string>>"
TREND = "struct<query:string,value:string,kind:string>"


def forum_posts(payloads: DataFrame, column: str = "payload", top: int = 5) -> DataFrame:
    """Links of forum posts: the body's first 600 characters, the counts, and up to ``top`` comments as snippet of at most 1500; unreadable payloads give no row."""
    p = payloads.withColumn("p", F.from_json(column, POST)).where("p.permalink is not null")
    counts = F.format_string("[r/%s · %s upvotes · %s comments]", "p.subreddit", "p.score", "p.num_comments")
    said = F.when(F.size("p.comments") > 0, F.concat(F.lit("Top comments: "), F.array_join(F.transform(F.slice("p.comments", 1, top), lambda x: F.trim(x)), " // ")))
    own = [c for c in payloads.columns if c != column]
    return p.select(
        *own, F.concat(F.lit("https://www.reddit.com"), "p.permalink").alias("url"), F.coalesce("p.title", F.lit("")).alias("title"),
        F.substring(F.concat_ws("\n", F.nullif(F.substring("p.selftext", 1, 600), F.lit("")), counts, said), 1, 1500).alias("snippet"),
        F.timestamp_micros((F.col("p.created_utc") * 1_000_000).cast("bigint")).alias("observed_at"), F.array(F.concat(F.lit("subreddit:"), F.lower("p.subreddit"))).alias("signal_tags"),
    )


def video_details(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Details of videos by id; counts that are no numbers are null; unreadable payloads give no row."""
    p = payloads.withColumn("p", F.from_json(column, VIDEO)).where("p.id is not null")
    n = {k: F.col(f"p.statistics.{v}").try_cast("bigint") for k, v in (("view_count", "viewCount"), ("like_count", "likeCount"), ("comment_count", "commentCount"))}
    own = [c for c in payloads.columns if c != column]
    return p.select(
        *own, F.col("p.id").alias("video"), F.col("p.snippet.title").alias("title"), F.col("p.snippet.channelTitle").alias("creator"), F.try_to_timestamp("p.snippet.publishedAt").alias("observed_at"),
        iso_seconds(F.col("p.contentDetails.duration")).alias("duration_sec"), *[v.alias(k) for k, v in n.items()], engagement(*n.values()).alias("engagement_score"), hashtags(F.col("p.snippet.title")).alias("hashtags"),
    )


def trends(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(query, kind, value) of related-search payloads; each query once whatever its case, the first kept by its order in the payload."""
    each = payloads.select("*", F.posexplode(F.from_json(column, f"array<{TREND}>")).alias("pos", "t"))
    own = [c for c in payloads.columns if c != column]
    named = each.select(*own, "pos", F.trim("t.query").alias("query"), F.coalesce("t.kind", F.lit("top")).alias("kind"), F.col("t.value").try_cast("int").alias("value")).where("length(query) between 3 and 120")
    return named.groupBy(*own, F.lower("query").alias("_k")).agg(F.min_by(F.struct("query", "kind", "value"), "pos").alias("r")).select(*own, "r.*")
