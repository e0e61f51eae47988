"""Exports: CSV with a byte order mark, nested JSON, and a self-contained HTML report."""

from __future__ import annotations

import html
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.links import VERDICT_ORDER
from factloom.session import cut, salted_join


def flat(df: DataFrame) -> DataFrame:
    """All columns as text: arrays joined by ' | ' on one line, booleans as true and false, fractions with at most six digits, null as ''."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = F.array_join(F.transform(c, lambda x: F.regexp_replace(x.cast("string"), r"[\r\n]+", " ")), " | ")
        elif kind in ("double", "float"):
            c = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", "")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def link_rows(links: DataFrame, videos: DataFrame) -> DataFrame:
    """The full row of each link as text, short-video columns empty for other links. Videos of one id count once."""
    line = lambda x: F.regexp_replace(x, r"[\r\n]", " ")
    bare = lambda x: F.regexp_replace(line(x), r"^\s+|\s+$", "")
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    items = lambda x: F.coalesce(F.array_join(F.transform(F.filter(x, lambda y: y != ""), bare), " | "), F.lit(""))
    number = lambda x: F.coalesce(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.col(x)), "0+$", ""), r"\.$", ""), F.lit(""))
    fraction = lambda x: F.when(F.col(x).isNull(), "").otherwise(F.coalesce(F.nullif(number(x), F.lit("")), F.lit("0")))
    at = lambda x: F.coalesce(F.concat(F.regexp_replace(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("+00:00")), F.lit(""))
    truth = lambda x: F.when(F.col(x), "true").when(~F.col(x), "false").otherwise("")
    extra = videos.groupBy("link_id").agg(*[F.first(x).alias(x) for x in ("hashtags", "top_comments", "transcript")])
    short = lambda v: F.when(F.col("is_short_video"), F.coalesce(v, F.lit(""))).otherwise("")
    return links.join(extra, "link_id", "left").select(
        "link_id", text("hypothesis_id").alias("hypothesis_id"), text("verdict").alias("verdict"), fraction("confidence").alias("confidence"), text("channel").alias("channel"), F.when(F.col("is_short_video"), "true").otherwise("false").alias("is_short_video"),
        F.coalesce(F.nullif("geo_scope", F.lit("")), F.lit("unknown")).alias("geo_scope"), text("url").alias("url"), F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url"), F.lit("")).alias("canonical_url"),
        line(text("title")).alias("title"), line(text("snippet")).alias("snippet"), short(F.col("creator")).alias("creator"), *[short(F.col(x).cast("string")).alias(x) for x in ("duration_sec", "view_count", "like_count", "comment_count", "share_count")],
        short(fraction("engagement_score")).alias("engagement_score"), short(items("hashtags")).alias("hashtags"), short(items("top_comments")).alias("top_comments"), short(bare(F.substring("transcript", 1, 500))).alias("transcript_preview"),
        items("signal_tags").alias("signal_tags"), items("also_found_on").alias("also_found_on"), text("query_text").alias("query_text"), F.coalesce(F.col("archetype").cast("string"), F.lit("")).alias("archetype"), text("archetype_name").alias("archetype_name"),
        truth("falsifier").alias("falsifier"), text("target_signal").alias("target_signal"), text("backend_used").alias("backend_used"), at("discovered_at").alias("discovered_at"), at("observed_at").alias("observed_at"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV part files, written in parallel, each with a header that begins with a byte order mark. Rows keep the order of df within a file, and files that of its partitions."""
    out = flat(df)
    out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Write df so that readers of ``path`` find the old table or the new one, never a part: to a folder beside it, then by a rename."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, old, target = hadoop(f"{path}.new-{uuid.uuid4().hex}"), hadoop(f"{path}.old-{uuid.uuid4().hex}"), hadoop(path)
    df.write.parquet(new.toString())
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        files.rename(target, old)
    if not files.rename(new, target):
        raise OSError(f"cannot rename the new table to {path}")
    files.delete(old, True)


def results_json(links: DataFrame, hypotheses: DataFrame, chunk: int = 1000) -> DataFrame:
    """(core_problem_id, hypothesis_id, part, result): a JSON text per hypothesis with its own columns, its verdict counts and all of its links by verdict.

    Links come whole, the most confident first; one without a verdict is tangential. A hypothesis without links
    has empty groups. One with more than ``chunk`` links comes in ``parts`` texts of about that many, split by a
    hash of the link id, each with the counts of the whole; only links whose hypothesis is not in the table are left out.
    """
    links = links.withColumn("_bucket", F.coalesce(F.nullif("verdict", F.lit("")), F.lit("tangential")))
    always = F.array(*[F.lit(v) for v in VERDICT_ORDER])
    counts = links.groupBy("hypothesis_id", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.groupBy("hypothesis_id").agg(F.map_from_entries(F.collect_list(F.struct("_bucket", "n"))).alias("_of"), F.sum("n").alias("n")))
    parts = F.ceil(F.col("n") / chunk).cast("int")
    big = cut(counts.where(F.col("n") > chunk).select("hypothesis_id", parts.alias("_k")))
    part = F.pmod(F.xxhash64("link_id"), F.coalesce("_k", F.lit(1))).cast("int")
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("o"), "link_id", "_bucket", F.struct(*[c for c in links.columns if c != "_bucket"]).alias("link"))
    held = salted_join(links, big, "hypothesis_id", F.col("link_id")).groupBy("hypothesis_id", part.alias("part")).agg(F.array_sort(F.collect_list(order)).alias("_all"))
    # parts are named before hypotheses meet their links, so a large hypothesis meets them in many tasks
    members = hypotheses.join(counts, "hypothesis_id", "left").withColumn("parts", F.coalesce(parts, F.lit(1)))
    members = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(held, ["hypothesis_id", "part"], "left")
    known = F.array_union(always, F.array_sort(F.coalesce(F.map_keys("_of"), F.array().cast("array<string>"))))
    named = F.map_from_arrays(known, F.transform(known, lambda v: F.coalesce(F.try_element_at("_of", v), F.lit(0))))
    rows = F.coalesce("_all", F.array().cast(held.schema["_all"].dataType))
    grouped = F.map_from_arrays(known, F.transform(known, lambda v: F.transform(F.filter(rows, lambda x: x["_bucket"] == v), lambda x: x["link"])))
    problem = F.coalesce("core_problem_id", F.lit("_uncategorized")).alias("core_problem_id")
    own = [problem if c == "core_problem_id" else F.col(c) for c in hypotheses.columns]
    result = F.struct(*own, "part", "parts", named.alias("verdict_counts"), grouped.alias("grouped"))
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return members.select(problem, "hypothesis_id", "part", F.to_json(result, options).alias("result"))


def html_report(summary: DataFrame) -> DataFrame:
    """(part, html): a page with one table of all rows, every value escaped, as one text per partition, to be written in order: the head is
    part of the first, the end of the last. Rows stay in the order of df."""
    columns = summary.columns
    cells = F.concat(*[F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(x).cast("string"), F.lit(""))), F.lit("</td>")) for x in columns])
    rows = summary.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("html"))
    head = "<!doctype html><meta charset=utf-8><title>Report</title><table><tr>" + "".join(f"<th>{html.escape(x)}</th>" for x in columns) + "</tr>"
    ends = summary.sparkSession.createDataFrame([(-1, -1, head), (2**31 - 1, 0, "</table>")], "part int, i long, html string")
    return rows.unionByName(ends)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
