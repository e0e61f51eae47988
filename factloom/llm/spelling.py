"""Duplicates hidden by formatting: canonical text, 128-bit hash, counts with map-side combining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, need

#: Percent-encoded blanks and punctuation: the ASCII ranges, then the UTF-8 bytes of the
#: no-break and soft signs, the general punctuation block, the word joiner and the byte order mark.
ENCODED = (
    "(?i)%(?:[01][0-9a-f]|2[0-9a-f]|3[a-f]|40|5[b-f]|60|7[b-f]"
    "|c2%(?:a[0-9a-f]|b[0-9a-f])|e2%80%[89ab][0-9a-f]|e2%81%a0|e3%80%[89][0-9a-f]|ef%bb%bf)"
)
_OTHER = r"[^\p{L}\p{M}\p{N}]+"


def canonical_text(text: Column) -> Column:
    """Letters, marks and digits of a text in lower case; null and blank texts give ''."""
    return F.coalesce(F.regexp_replace(F.lower(text), _OTHER, ""), F.lit(""))


def canonical_url(url: Column) -> Column:
    """canonical_text of the address, its sorted query parameters and its fragment.

    Parameters are split at literal ampersands and semicolons, so an encoded one stays part
    of its value; a parameter without letters or digits does not count."""
    plain = lambda c: canonical_text(F.regexp_replace(c, ENCODED, ""))
    whole = F.coalesce(url, F.lit(""))
    head = F.substring_index(whole, "#", 1)
    base = F.substring_index(head, "?", 1)
    query = F.substring(head, F.length(base) + 2, F.length(head))
    params = F.array_sort(F.filter(F.transform(F.split(query, "[&;]"), plain), lambda p: p != ""))
    fragment = F.substring(whole, F.length(head) + 2, F.length(whole))
    return F.concat_ws("?", plain(base), F.nullif(F.concat_ws("&", params), F.lit("")), F.nullif(F.concat(F.lit("#"), plain(fragment)), F.lit("#")))


def record_keys(df: DataFrame, id_col: str, texts: Sequence[str], urls: Sequence[str] = ()) -> DataFrame:
    """(id, h128, check): the MD5 of the canonical record and an independent 64-bit hash of it.

    Fields are canonicalised one by one and joined by a control character that no
    canonical field can hold; urls and texts are taken in sorted order of their names."""
    need(df, [id_col, *texts, *urls])
    parts = [canonical_url(F.col(c)) if c in set(urls) else canonical_text(F.col(c)) for c in sorted([*texts, *urls])]
    return df.select(F.col(id_col).alias("id"), F.concat_ws("\u0001", *parts).alias("_c")).select(
        "id", F.unhex(F.md5("_c")).alias("h128"), F.xxhash64(F.reverse("_c"), F.length("_c")).alias("check")
    )


def collapse(keys: DataFrame) -> DataFrame:
    """One row per record: (h128, check, keep_id, n_copies).

    The check hash is part of the key, so two different records that collide in
    the 128 bits stay apart; ``collisions`` counts them. Partial counts are combined
    before the shuffle, so a record that holds a third of all rows costs one row a task.
    """
    return keys.groupBy("h128", "check").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))


def collisions(records: DataFrame) -> DataFrame:
    """128-bit hashes shared by different records (expected: none)."""
    return records.groupBy("h128").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def summary(records: DataFrame) -> DataFrame:
    """One row on the whole collapse: rows, records, rows that are copies, and 128-bit hashes that different records share."""
    per_hash = records.groupBy("h128").agg(F.sum("n_copies").alias("n"), F.count(F.lit(1)).alias("k"))
    whole = per_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_records"), F.count_if(F.col("k") > 1).alias("n_collisions"))
    return whole.withColumn("n_copies", F.col("n_rows") - F.col("n_records"))


def copies(keys: DataFrame, hot_share: int = 4096) -> DataFrame:
    """(keep_id, copy_id) for every row that is not the first of its record.

    Rows with a null id give no pair. A record with at least 1/hot_share of all rows
    is hot; there can be no more than hot_share of them, so they are broadcast and
    their rows never shuffle; the rest meets in an ordinary equi-join. ``keys`` is
    read twice, so it is written to the shared folder first.
    """
    keys = cut(keys.where("id is not null"))
    n = keys.count()
    groups = cut(collapse(keys).where("n_copies > 1"))
    floor = max(2, -(-n // hot_share))
    hot, cold = groups.where(F.col("n_copies") >= floor), groups.where(F.col("n_copies") < floor)
    parts = [keys.join(F.broadcast(hot), ["h128", "check"]), keys.join(F.broadcast(hot.select("h128", "check")), ["h128", "check"], "left_anti").join(cold, ["h128", "check"])]
    return parts[0].unionByName(parts[1]).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
