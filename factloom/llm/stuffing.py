"""Keyword-stuffed and link-list pages: rank-frequency curves in SQL windows, then a reading of the flagged pages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.session import cut, need, ship, spread

#: Closed-class words by language, which head the rank-frequency curve of any prose. Fixed values.
FUNCTION_WORDS = {
    "en": "the a an of and or to in on at by for from with as is are was it its that this each one their i my you not than which who if after about",
    "de": "der die das den dem ein von und zu in im auf mit aus als ist es nicht mir man aber weil bis nach",
    "fr": "le la les un une de du des et à en dans pour avec est que qui ne pas ce mon il on mais plus",
    "es": "el la los un una de del y a en con por para que es no lo se mi este ese cada pero más",
    "it": "il lo la i un di del della e a in con per che è non mi mia si questo quel ma più",
    "pt": "o a os um uma de do da e em no na com para que é não se meu este cada mas mais",
    "nl": "de het een van en te op met uit als is dat die niet ik mijn me je dit wat maar zo",
    "hi": "का की के को में से पर है और यह मेरा मेरे मेरी नहीं तो ही भी जो मैं आप कोई वाला तक हो जब लेकिन क्योंकि जैसा",
    "hi-latn": "ka ki ke ko mein se par hai aur yeh mera mere meri nahin to hi bhi jo main aap koi wala tak ho jab lekin kyunki jaisa",
}
WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ALL = frozenset().union(*WORDS.values())
_SPEAKS = {w: tuple(k for k, v in WORDS.items() if w in v) for w in _ALL}
_WORD = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?"
_TOKEN = re.compile(_WORD)
_LINK = re.compile(r"<a|\[?[\p{L}\p{M} ]*\]?\(?https?:|www\.|#\w|\S+\.[a-z]+/")
#: Reading of a page: windows of about SPAN tokens. A window is no prose if its share of function
#: words is under LEAN, or its share of links and tags over LINKS, or that of stuffed words over STUFFED
#: while it has fewer function words than FULL.
SPAN, LEAN, LINKS, STUFFED, FULL = 36, 0.13, 0.3, 0.26, 0.29
#: Words count as stuffed from this many occurrences and this share of the page's tokens.
OFTEN, SHARE = 4, 0.03
#: A page is extreme beyond this many quartile ranges from the median of its language and length.
EXTREME = 1.5


def curves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per page: its language by function words, and the shape of its rank-frequency curve.

    Columns: id, lang, n_tokens, n_words, slope and residual of ln frequency over ln
    rank, ``prose`` (share of function words of the language), ``stuffed`` (share of frequent
    other words), ``links`` (share of tokens in links and tags). Pages are hashed by id once; counting, ranking and
    fitting then run inside those partitions. Pages without any token give no row.
    """
    tokens = F.regexp_extract_all(F.lower(text_col), F.lit(f"({_WORD})"), 1)
    marks = F.regexp_count(text_col, F.lit(r"(?:https?://|www\.|#\w|\S+\.[a-z]+/)"))
    chunks = F.regexp_count(text_col, F.lit(r"\S+"))
    # a token-less page still carries its links, as one row with a null word
    # shares of the whole text are computed below the explode, once a page
    page_rows = docs.select(F.col(id_col).alias("id"), (marks / F.greatest(chunks, F.lit(1))).alias("links"), tokens.alias("ws"))
    # words travel as hashes, and only the closed-class words are looked up, in one small table of fixed size
    words = page_rows.select("id", "links", F.explode_outer(F.transform("ws", lambda w: F.xxhash64(w))).alias("w"))
    counted = words.groupBy("id", "w").agg(F.count("w").alias("n"), F.max("links").alias("links"))
    page = Window.partitionBy("id")
    ranked = counted.withColumns({"r": F.row_number().over(page.orderBy(F.desc("n"), "w")), "total": F.sum("n").over(page)})
    langs = sorted(WORDS)
    closed = docs.sparkSession.createDataFrame([(w, sum(1 << i for i, k in enumerate(langs) if w in WORDS[k])) for w in sorted(_ALL)], "word string, mask int")
    known = ranked.join(F.broadcast(closed.select(F.xxhash64("word").alias("w"), "mask")), "w", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    x, y = F.log("r"), F.log(F.greatest("n", F.lit(1)))
    own = {k: F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i, k in enumerate(langs)}
    frequent = (F.col("n") >= OFTEN) & (F.col("n") >= SHARE * F.col("total")) & (F.col("mask") == 0) & F.col("w").isNotNull()
    fitted = known.groupBy("id").agg(
        F.first("total").alias("n_tokens"), F.count("w").alias("n_words"), F.max("links").alias("links"),
        F.regr_slope(y, x).alias("slope"), F.var_pop(y).alias("vy"), F.var_pop(x).alias("vx"), F.covar_pop(y, x).alias("cxy"),
        F.sum(F.when(frequent, F.col("n")).otherwise(0)).alias("often"), *[v.alias(f"f_{k}") for k, v in own.items()],
    )
    best = F.greatest(*[F.struct(F.col(f"f_{k}").alias("n"), F.lit(k).alias("k")) for k in WORDS])
    size = F.greatest("n_tokens", F.lit(1))
    return fitted.select(
        "id", best["k"].alias("lang"), "n_tokens", "n_words", F.coalesce("slope", F.lit(0.0)).alias("slope"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - F.when(F.col("vx") > 0, F.col("cxy") * F.col("cxy") / F.col("vx")).otherwise(0.0))).alias("residual"),
        (best["n"] / size).alias("prose"), (F.col("often") / size).alias("stuffed"), "links",
    )


def extremes(pages: DataFrame) -> DataFrame:
    """The pages whose curve is extreme among pages of the same language and comparable length (doubling
    classes), or far from prose in absolute terms. Medians and quartiles cover all pages; their table has at
    most one row per language and length class, so it is broadcast."""
    pages = pages.withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))))
    marks = ["slope", "residual", "prose", "stuffed"]
    normal = pages.groupBy("lang", "size").agg(*[F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q_{m}") for m in marks])
    seen = pages.join(F.broadcast(normal), ["lang", "size"])

    def far(m: str, side: int) -> F.Column:
        q = F.col(f"q_{m}")
        return side * (F.col(m) - q[1]) > EXTREME * F.greatest(q[2] - q[0], F.lit(0.02))

    odd = far("slope", -1) | far("slope", 1) | far("residual", 1) | far("residual", -1) | far("prose", -1) | far("stuffed", 1)
    return seen.where(odd | (F.col("prose") < 0.3) | (F.col("stuffed") > 0.12) | (F.col("links") > 0.1)).select(*pages.columns)


def unread_share(text: str, memo: dict[str, tuple[bool, tuple[str, ...]]] | None = None) -> float:
    """Share of a text, by characters, that stands in windows that are not prose. ``memo`` keeps (is it a link, its words) of tokens between pages."""
    memo = {} if memo is None else memo
    lines = [line.split() for line in text.split("\n")]
    for line in lines:
        for t in line:
            if t not in memo:
                link = bool(_LINK.match(t))
                memo[t] = link, () if link else tuple(_TOKEN.findall(t.lower()))
    count = Counter(w for line in lines for t in line for w in memo[t][1])
    size = sum(count.values())
    stuffed = {w for w, n in count.items() if n >= OFTEN and n >= SHARE * size and w not in _ALL}
    total = bad = 0
    for tokens in lines:
        k = len(tokens)
        parts = max(1, round(k / SPAN)) if k else 0
        for i in range(parts):
            some = tokens[i * k // parts : (i + 1) * k // parts]
            links = often = 0
            heads: Counter[str] = Counter()
            for t in some:
                link, words = memo[t]
                links += link
                for w in words:
                    if w in _SPEAKS:
                        heads.update(_SPEAKS[w])
                    elif w in stuffed:
                        often += 1
            n, chars = len(some), sum(map(len, some)) + len(some)
            prose = max(heads.values(), default=0) / n
            total += chars
            bad += chars * (prose < LEAN or links > LINKS * n or (prose < FULL and often > STUFFED * n))
    if len(memo) > 200_000:
        memo.clear()
    return bad / total if total else 0.0


def find_stuffed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.45) -> DataFrame:
    """(id, lang, slope, residual, prose, stuffed, unread): pages whose larger part is repeated keywords, links or tags.

    Candidates are the extremes of the rank-frequency curves of all pages; each
    candidate's whole text is then read in windows and kept if more than ``share`` of it
    is no prose. Null and empty texts are no pages. Equal rows count as one page; a
    null id is a page of its own id null. Extra columns are ignored.
    """
    ship(docs.sparkSession)
    need(docs, [id_col, text_col])
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0")
    own = own.repartition(spread(docs), "id").distinct()  # equal rows share a partition by now
    flagged = extremes(cut(curves(own, "id", "text")))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[bool, tuple[str, ...]]] = {}
        for part in parts:
            part["unread"] = [unread_share(t, memo) for t in part.pop("text")]
            yield part[part["unread"] > share]

    kind = dict(docs.dtypes)[id_col]
    both = own.join(flagged, own["id"].eqNullSafe(flagged["id"])).select(own["id"], "text", "lang", "slope", "residual", "prose", "stuffed", "links")
    return both.mapInPandas(read, f"id {kind}, lang string, slope double, residual double, prose double, stuffed double, links double, unread double").withColumnRenamed("id", id_col)
