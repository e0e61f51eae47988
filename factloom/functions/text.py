"""Text and video expressions. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not widen a signal pattern. Fixed values.
STOPWORDS = "a an and as at be by for from in is it of on or rate rates ratio the to with".split()
_ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def normalise(text: Column) -> Column:
    """Lower case, blanks collapsed and trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+", " "))


def content_hash(title: Column, body: Column) -> Column:
    """First 16 hex digits of the SHA-1 of title and the first 200 characters of the body, both normalised;
    null below 16 characters, which would merge unrelated links."""
    both = F.regexp_replace(F.concat(normalise(title), F.lit("\n"), normalise(F.substring(body, 1, 200))), r"^\s+|\s+$", "")
    both = F.coalesce(both, F.regexp_replace(F.concat(normalise(title), F.lit("\n")), r"^\s+|\s+$", ""))
    return F.when(F.length(both) >= 16, F.substring(F.sha1(both), 1, 16))


def strip_html(html: Column, dropped: str = "script|style", inside_body: bool = False) -> Column:
    """Text of a page: elements to drop go with their content, other tags and unknown entities become blanks."""
    text = F.regexp_replace(html, rf"(?is)<({dropped})[^>]*>.*?</\1>", " ")
    if inside_body:
        inner = F.regexp_extract(text, r"(?is)<body[^>]*>(.*?)</body>", 1)
        text = F.when(inner != "", inner).otherwise(text)
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for a, b in _ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "&[a-zA-Z]+;", " "), r"\s+", " "))


def hashtags(text: Column) -> Column:
    """Hash tags in lower case, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#([A-Za-z0-9_À-ɏḀ-ỿ]+)"), 1), F.lower))


def video_id(url: Column) -> Column:
    """The 11-character id in any of the four url shapes, else null."""
    shapes = (r"(?i)youtube\.com/watch\?(?:[^#]*?&)?v=([A-Za-z0-9_-]{11})", r"(?i)youtube\.com/shorts/([A-Za-z0-9_-]{11})", r"(?i)youtube\.com/embed/([A-Za-z0-9_-]{11})", r"(?i)youtu\.be/([A-Za-z0-9_-]{11})")
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in shapes])


def clock_seconds(text: Column) -> Column:
    """Seconds of the first m:ss or h:mm:ss in a text, else null."""
    p = r"(?:^|[\s(])(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[\s)]|$)"
    a, b, c = (F.regexp_extract(text, p, k).try_cast("int") for k in (1, 2, 3))
    return F.when(a.isNull(), None).when(c.isNull(), a * 60 + b).otherwise(a * 3600 + b * 60 + c)


def iso_seconds(text: Column) -> Column:
    """Seconds of PT#H#M#S; null for zero or anything else."""
    p = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    h, m, s = (F.coalesce(F.regexp_extract(text, p, k).try_cast("int"), F.lit(0)) for k in (1, 2, 3))
    return F.nullif(h * 3600 + m * 60 + s, F.lit(0))


def engagement(views: Column, likes: Column, comments: Column) -> Column:
    """min(1, (likes + 3 comments) / views) to six digits, half-even; null without views."""
    return F.when(views > 0, F.least(F.bround((F.coalesce(likes, F.lit(0)) + 3 * F.coalesce(comments, F.lit(0))) / views, 6), F.lit(1.0)))


def list_cell(cell: Column) -> Column:
    """Values of a packed cell by the plain rule: bar, else semicolon, else comma unless the cell is bracketed."""
    bare = F.trim(cell)
    sep = F.when(bare.contains("|"), r"\|").when(bare.contains(";"), ";").when(bare.contains(",") & ~(bare.startswith("[") & bare.endswith("]")), ",")
    parts = F.when(sep.isNotNull(), F.split(bare, F.coalesce(sep, F.lit(",")))).otherwise(F.array(F.regexp_replace(bare, r"^\[+|\]+$", "")))
    clean = F.transform(parts, lambda p: F.regexp_replace(p, r"""^[\s"']+|[\s"']+$""", ""))
    return F.filter(clean, lambda p: p != "")


def signal_terms(signals: Column) -> Column:
    """Words of the signals in lower case, without stop words, each once, in order."""
    words = F.flatten(F.transform(signals, lambda s: F.split(F.lower(s), r"[_\s/]+")))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS)))


def term_pattern(terms: Column) -> Column:
    """A pattern for any of the terms with a common ending; null without terms."""
    plain = F.filter(F.transform(terms, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}\-]", "")), lambda t: t != "")
    return F.when(F.size(plain) > 0, F.concat(F.lit(r"(?i)\b("), F.array_join(plain, "|"), F.lit(r")(?:s|es|ed|ing|er|ers|ly)?\b")))


def matched(text: Column, pattern: Column) -> Column:
    """The terms that a pattern of term_pattern meets in a text, each once in lower case, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, pattern, 1), F.lower))


def hit_rate(text: Column, pattern: Column) -> Column:
    """Matches per word, at most 1; 0 without text or pattern."""
    words = F.greatest(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")), F.lit(1))
    return F.coalesce(F.least(F.regexp_count(text, pattern) / words, F.lit(1.0)), F.lit(0.0))


def verdict(text: Column, signal: Column, counter: Column, base: float = 0.5) -> tuple[Column, Column]:
    """(verdict, confidence) by the rule for when no model answers; equal rates support."""
    name = F.when(F.coalesce(text, F.lit("")) == "", "tangential").when((counter > signal) & (counter > 0), "refutes").when(signal > 0, "supports").otherwise("tangential")
    sure = F.when(name == "refutes", F.least(F.lit(0.85), base + counter * 25)).when(name == "supports", F.least(F.lit(0.85), base + signal * 25)).otherwise(0.3)
    return name, sure
