"""Mixing sources to target weights: entropy balancing of document rates, rounded into copies."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.session import cut, need, ship, widen

#: Folder of the public vocabulary files; a parameter, never part of the package.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MAX_SOURCES = 10_000


def source_key(source: Column) -> Column:
    """One spelling per source: trimmed, lower case, blanks and dashes as underscores; null if blank."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(source), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\-]+", "_"), F.lit(""))


def with_tokens(docs: DataFrame, text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """docs with ``n_tokens`` of a public byte-level tokenizer; null and empty texts have 0. The vocabulary is read
    from ``folder`` on each executor, once a worker."""
    path = os.path.join(folder, name)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        codec = tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for part in parts:
            yield pd.Series([len(codec.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in part], dtype="int64")

    return docs.withColumn("n_tokens", count(text_col))


def balance(sizes: DataFrame, goals: dict[str, tuple[float, int]], rounds: int = 60, tolerance: float = 1e-9) -> dict[str, float]:
    """Multipliers of the entropy-balancing dual, by Newton's method.

    ``sizes`` holds (source, n_tokens, n) counts; goals gives each source its token goal and cap. A document of t
    tokens gets the rate min(cap, exp(m * t / mean)): the least change from one copy each, in relative entropy, that meets the
    token constraint of its source. Gradient and (diagonal) Hessian are sums over the
    data, one distributed aggregate a round; a step is halved while it overshoots.
    """
    spark = sizes.sparkSession
    mean = {r["source"]: max(1.0, r["m"]) for r in sizes.groupBy("source").agg((F.sum(F.col("n") * F.col("n_tokens")) / F.sum("n")).alias("m")).collect()}
    theta = dict.fromkeys(mean, 0.0)
    low, high = dict.fromkeys(mean, -math.inf), dict.fromkeys(mean, math.inf)
    for _ in range(rounds):
        now = spark.createDataFrame([(s, theta[s], mean[s], float(goals[s][1])) for s in mean], "source string, theta double, mean double, cap double")
        # one row a source, at most MAX_SOURCES (checked by the caller)
        raw = F.exp(F.least(F.col("theta") * F.col("n_tokens") / F.col("mean"), F.lit(60.0)))
        rate = F.least(raw, F.col("cap"))
        free = F.when(raw < F.col("cap"), rate).otherwise(0.0)
        t = F.col("n_tokens")
        sums = sizes.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(F.col("n") * rate * t).alias("got"), F.sum(F.col("n") * free * t * t / F.col("mean")).alias("slope")).collect()
        worst = 0.0
        for r in sums:
            s, goal = r["source"], goals[r["source"]][0]
            gap = r["got"] - goal
            worst = max(worst, abs(gap) / max(goal, 1.0))
            if gap > 0:
                high[s] = min(high[s], theta[s])
            else:
                low[s] = max(low[s], theta[s])
            step = theta[s] - gap / r["slope"] if r["slope"] > 0 else (theta[s] - 1 if gap > 0 else theta[s] + 1)
            if not low[s] < step < high[s]:  # Newton overshot the bracket
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else theta[s] + (-1.0 if gap > 0 else 1.0)
            theta[s] = max(-60.0, min(60.0, step))
        if worst < tolerance:
            break
    return theta


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, id_col: str = "doc_id", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(documents, shares): the chosen documents with their copies, and what each source gets.

    documents: id, source, n_tokens, rate, copies (at least 1, at most max_repeats of the source).
    shares: source, target_share, tokens, actual_share, n_docs, n_copies, reachable (whether the cap lets the
    source reach its target). ``total`` defaults to the largest size, up to that of all listed sources, at
    which every source with documents can reach its target.

    Documents without a listed source, or without tokens, are not chosen; a target repeated in another spelling
    counts once (the larger); sources without documents stay in the shares with 0 tokens. Rates are rounded by a hash of
    the id plus one offset per source, chosen so that the rounded tokens come closest to
    the goal; ties and repeated ids get the same copies. No source is gathered in one task: all steps are narrow or sums.
    """
    need(docs, [id_col, "source", "text"])
    ship(docs.sparkSession)
    spark = docs.sparkSession
    plan = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null and target_share > 0").limit(MAX_SOURCES + 1).collect()
    if len(plan) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    whole = sum(r["target_share"] for r in plan) or 1.0
    share = {r["source"]: r["target_share"] / whole for r in plan}
    cap = {r["source"]: max(1, int(r["max_repeats"] or 1)) for r in plan}
    listed = spark.createDataFrame([(s,) for s in share] or [("",)], "source string")
    slim = widen(docs.select(id_col, "source", "text")).select(F.col(id_col), source_key(F.col("source")).alias("source"), "text").join(F.broadcast(listed), "source")
    sized = cut(with_tokens(slim, "text", folder).drop("text").where("n_tokens > 0").withColumn("u", F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)))
    sizes = cut(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r["source"]: float(r["t"]) for r in sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect()}
    if total is None:
        total = min([sum(have.values()), *(cap[s] * have[s] / share[s] for s in have)], default=0.0)
    goals = {s: (share[s] * total, cap[s]) for s in have}
    theta = balance(sizes, goals) if have else {}
    mean = {r["source"]: max(1.0, r["m"]) for r in sizes.groupBy("source").agg((F.sum(F.col("n") * F.col("n_tokens")) / F.sum("n")).alias("m")).collect()}
    rules = spark.createDataFrame([(s, theta[s], mean[s], cap[s]) for s in have] or [("", 0.0, 1.0, 1)], "source string, theta double, mean double, cap int")
    rated = sized.join(F.broadcast(rules), "source").withColumn("rate", F.least(F.exp(F.least(F.col("theta") * F.col("n_tokens") / F.col("mean"), F.lit(60.0))), F.col("cap").cast("double")))
    offset = dict.fromkeys(have, 0.0)
    width = 1.0
    for _ in range(3):  # each pass narrows the offset of every source to a twentieth
        table = spark.createDataFrame([(s, o) for s, o in offset.items()] or [("", 0.0)], "source string, o double")
        grid = [width * (k / 20 - 0.5) * 2 for k in range(21)]
        sums = rated.join(F.broadcast(table), "source").groupBy("source").agg(
            *[F.sum(F.col("n_tokens") * F.least(F.greatest(F.floor(F.col("rate") + F.col("u") + F.col("o") + F.lit(g)), F.lit(0)), F.col("cap"))).alias(f"g{k}") for k, g in enumerate(grid)]
        )
        for r in sums.collect():
            s = r["source"]
            best = min(range(len(grid)), key=lambda k: (abs(r[f"g{k}"] - goals[s][0]), abs(grid[k])))
            offset[s] += grid[best]
        width /= 10
    table = spark.createDataFrame([(s, o) for s, o in offset.items()] or [("", 0.0)], "source string, o double")
    copies = F.least(F.greatest(F.floor(F.col("rate") + F.col("u") + F.col("o")), F.lit(0)), F.col("cap")).cast("int")
    chosen = rated.join(F.broadcast(table), "source").select(id_col, "source", "n_tokens", F.round("rate", 6).alias("rate"), copies.alias("copies")).where("copies > 0")
    asked = spark.createDataFrame([(s, share[s], bool(s in have and cap[s] * have[s] >= share[s] * total * (1 - 1e-9))) for s in share] or [("", 0.0, False)], "source string, target_share double, reachable boolean")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "n_docs", "n_copies")]
    whole_sum = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row a source
    shares = asked.where("source <> ''").join(got, "source", "left").select(
        "source", "target_share", *zero, F.round(F.coalesce(F.col("tokens") / whole_sum, F.lit(0.0)), 6).alias("actual_share"), "reachable"
    )
    return chosen, shares
