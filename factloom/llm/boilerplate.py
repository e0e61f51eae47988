"""Main text of pages: wrapper induction over the pages of a site.

A body is a tree of lines below its page. Pages of one site are aligned node by node; nodes that
recur as the site's own become its template, and what varies is content. Texts that
every site uses alike (subheads, stock sentences) recur too, so a node counts as
template only if its occurrences cluster by site far beyond chance, or if it stands outside the main text.
"""

from __future__ import annotations

import re as plain_re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex as re
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.stuffing import WORDS
from factloom.session import cut, need, ship, spread

#: A line of this many characters is a paragraph.
PARAGRAPH = 100
#: Keys seen on fewer pages are left to their place in the page.
FEW = 4
_HOST = re.compile(r"^\s*(?:[a-z][\w+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.I)
_HOST_SQL = "(?i)" + _HOST.pattern
_WORD = re.compile(r"[\p{L}\p{M}]+")
_DIGITS, _TAIL, _QUERY, _SIGNS = (plain_re.compile(x) for x in (r"\d+", r"-\d+$", r"[?#].*$", r"[^a-z0-9]+"))
#: Second labels under which two-letter domains give out names, as in a.co.uk. Fixed values.
_SECOND = "co com org net gov gob gouv ac edu or ne go in firm gen ind".split()
#: Lines that name themselves as furniture, for sites too few in a language to compare: adverts, links to more, sharing, a site's word on its
#: cookies. Fixed values.
_MARKS = plain_re.compile(
    r"^(?:advertisement|anzeige|werbung|publicidad|publicité|pubblicità|publicidade|advertentie|विज्ञापन)(?:[\s:\-].{0,40})?$"
    r"|^(?:related|read also|see also|you may also like|lesen sie auch|lee también|à lire aussi|leggi anche|leia também|lees ook|यह भी पढ़ें)\s*:"
    r"|^(?:share(?: this)?|teilen|comparte|compartir|partager|condividi|compartilhar|delen|साझा करें)\s*:"
    r"|^(?:tags|etiquetas|schlagwörter|mots-clés|tag|etichette|trefwoorden|टैग)\s*:"
    r"|\bcookies?\b.*§|§.*\bcookies?\b|कुकीज़.*§|§.*कुकीज़"
    r"|^(?:story continues|continue reading|weiter geht es|sigue leyendo|आगे पढ़)"
)
#: Three or more short names between equal separators.
_ROW = re.compile(r"^(?:[\p{L}\p{M}'’]+ ){0,2}[\p{L}\p{M}'’]+(?P<sep> [·|/>›»•\-] )(?:[\p{L}\p{M}'’]+ ){0,2}[\p{L}\p{M}'’]+(?:(?P=sep)(?:[\p{L}\p{M}'’]+ ){0,2}[\p{L}\p{M}'’]+)+$")
_BULLET = plain_re.compile(r"^\s*(?:[-*•]|\d+[.)])\s")
_END = plain_re.compile(r"[.!…。।](?:[\"'”’)]*)$")


def site_of(url: str | None) -> str:
    """The name of a url's host that is given out to a site: its last two labels, three below a shared second label; '' without a host."""
    m = _HOST.match(url or "")
    if not m:
        return ""
    labels = m[1].lower().rstrip(".").split(".")
    return ".".join(labels[-3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND else -2 :])


def site_column(url: Column) -> Column:
    """site_of as an expression."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST_SQL, 1)), r"\.+$", "")
    return F.regexp_extract(host, rf"(?:[^.]*\.(?:{'|'.join(_SECOND)})\.[a-z][a-z]|[^.]*\.[^.]*|[^.]*)$", 0)


def path_of(url: str | None) -> str:
    """Host and path of a url, which name a page whatever its query."""
    return _QUERY.sub("", (url or "").strip()).rstrip("/").lower()


def label(line: str, site: str) -> str:
    """Name of a line node: lower case, the site's own name as §, numbers as #, single blanks."""
    text = line.lower()
    name = site.split(".")[0]
    if len(name) > 2:
        text = text.replace(name, "§")
    return " ".join(_DIGITS.sub("#", text).split())


def keys_of(name: str) -> list[str]:
    """A node's name, and the names of the slots it may fill: its lead before a colon, its first two words."""
    out = ["=" + name]
    words = name.split(" ")
    lead = name.split(":", 1)[0]
    if lead != name and len(lead) <= 40 and lead.count(" ") < 3:
        out.append(":" + lead)
    if len(words) >= 3:
        out.append("2" + " ".join(words[:2]))
    return out


def code(key: str) -> int:
    """A key as a signed 64-bit hash, in which it travels."""
    n = xxhash.xxh64_intdigest(key)
    return n - (1 << 64) if n >= 1 << 63 else n


_SPEAKS = {w: tuple(k for k, v in WORDS.items() if w in v) for w in frozenset().union(*WORDS.values())}


def language(text: str) -> str:
    """The language with the most function words over the whole text; ties go to the later code."""
    seen = Counter(w for w in _WORD.findall(text.lower()) if w in _SPEAKS)
    count = dict.fromkeys(WORDS, 0)
    for w, n in seen.items():
        for k in _SPEAKS[w]:
            count[k] += n
    return max(count, key=lambda k: (count[k], k)).split("-")[0]


def headline_at(lines: list[str], url: str | None) -> int:
    """Number of the line that the last part of the url spells, or -1."""
    slug = _TAIL.sub("", path_of(url).rsplit("/", 1)[-1])
    if len(slug) < 8 or "-" not in slug:
        return -1
    for i, line in enumerate(lines):
        if _SIGNS.sub("-", line.lower()).strip("-").startswith(slug):
            return i
    return -1


def nodes(text: str, url: str | None, site: str) -> list[tuple[str, str]]:
    """(key, zone) of every distinct key of a page; zone is before, after, inside (m) or unknown (n), with p if the page has a paragraph, else q. '>' keys are the
    names of lines followed by two short open lines: heads of lists of links."""
    lines = text.split("\n")
    names = [label(line, site) for line in lines]
    head = headline_at(lines, url)
    long = [i for i, line in enumerate(lines) if len(line) >= PARAGRAPH]
    out: dict[str, str] = {}
    for i, name in enumerate(names):
        if not name or i == head:
            continue
        top = head if head > -1 else long[0] - 1 if long else -1
        zone = "b" if i < top else "a" if long and i > long[-1] else "m" if long and head > -1 else "n"
        for k in keys_of(name):
            out.setdefault(k, zone)
        after = range(i + 1, i + 3)
        if i + 2 < len(lines) and head not in after and all(0 < len(lines[j]) < PARAGRAPH and not _END.search(lines[j]) and lines[j].count(" ") >= 2 for j in after):
            out.setdefault(">" + name, zone)
    full = "p" if long else "q"
    return [(k, z + full) for k, z in out.items()]


def induce(bodies: DataFrame) -> DataFrame:
    """Template verdicts: (site, key as its code, verdict): 't' for template, 'c' for content ('C' if often seen), 'h' for the head of a link list.

    Counts cover all bodies but refetches: bodies of one host and path with the same text count once, whatever
    their queries; without a usable url each body counts. For each language and key, Pearson's statistic over sites compares its pages with the
    sizes of the sites; only sites that have the key enter the sum, the others add their expectation.
    """
    ship(bodies.sparkSession)

    def tree(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url, text in zip(part["url"], part["text"], strict=True):
                site = site_of(url)
                lang = language(text)
                rows.append((site, lang, "", 0, ""))
                rows += [(site, lang, k[0], code(k), z) for k, z in nodes(text, url, site)]
            yield pd.DataFrame(rows, columns=["site", "lang", "kind", "key", "zone"])

    pages = bodies.where("length(text) > 0")
    path = F.lower(F.regexp_replace(F.trim("url"), r"/*(?:[?#].*)?$", ""))
    # without a host a path names no page, so such a body is repeated only by its own id
    page = F.when(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST_SQL, 1) != "", path)
    alone = F.when(page.isNull(), F.col("body_id"))
    # ids are picked before texts move; a repeated id keeps all its rows only if their texts differ
    ids = pages.groupBy(page.alias("_p"), alone.alias("_i"), F.xxhash64("text").alias("_t"), F.length("text").alias("_n")).agg(F.min("body_id").alias("body_id")).select("body_id", "_t")
    hashed = pages.withColumn("_t", F.xxhash64("text")).repartition(spread(bodies), "body_id", "_t")
    first = hashed.join(ids.distinct().hint("shuffle_hash"), ["body_id", "_t"], "left_semi").select("url", "text")
    counted = cut(first.mapInPandas(tree, "site string, lang string, kind string, key long, zone string").groupBy("lang", "kind", "key", "site").agg(
        F.count(F.lit(1)).alias("c"), *[F.sum(F.col("zone").contains(z).cast("int")).alias(z) for z in "bamp"],
    ))
    sites = counted.where("kind = ''").select("lang", "site", F.col("c").alias("pages"))
    langs = sites.groupBy("lang").agg(F.sum("pages").alias("total"), F.count(F.lit(1)).alias("n_sites"), F.sum(1 / F.col("pages")).alias("rev"))
    # languages are bounded by the word lists, so their table is broadcast
    per_site = counted.where("kind <> ''").join(sites, ["lang", "site"]).join(F.broadcast(langs), "lang")
    # counts per key first: expectation needs the key's total
    totals = counted.where("kind <> ''").groupBy("lang", "kind", "key").agg(F.sum("c").alias("n")).where(f"n >= {FEW}")
    both = per_site.join(totals, ["lang", "kind", "key"])
    expect = F.col("n") * F.col("pages") / F.col("total")
    stats = both.groupBy("lang", "kind", "key").agg(
        F.first("n").alias("n"), F.first("n_sites").alias("s"), F.first("total").alias("t"), F.first("rev").alias("rev"),
        (F.sum((F.col("c") - expect) * (F.col("c") - expect) / expect - expect) + F.first("n")).alias("chi"),
        *[F.sum(z).alias(z) for z in "bamp"],
    )
    # mean s-1 and variance of Pearson's statistic under even spread
    noise = F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("s") - 1) + (F.col("t") * F.col("rev") - F.col("s") * F.col("s") - 2 * F.col("s") + 2) / F.col("n")))
    over = (F.col("chi") - F.col("s")) / F.greatest(noise, F.lit(1.0))
    clustered = (over > 4) & (F.col("chi") / F.col("s") > 2)
    edge = F.coalesce((F.col("a") + F.col("b")) / F.nullif(F.col("a") + F.col("b") + F.col("m"), F.lit(0)), F.lit(0.0))
    full = F.col("kind") == "="
    outside = (edge >= 0.75) & (F.col("a") + F.col("b") >= 3) & full
    # what stands instead of a main text (errors, filler) is not part of the frame: the frame also surrounds real texts
    around = F.col("p") >= 0.6 * F.col("n")
    frame = (clustered | outside) & around
    verdict = F.when(F.col("kind") == ">", F.when(frame, "h")).otherwise(F.when(frame, "t").when(F.col("n") >= 60, "C").when(F.col("n") >= 12, "c"))
    verdicts = stats.select("lang", "kind", "key", "n", verdict.alias("verdict")).where("verdict is not null")
    known = counted.where("kind <> ''").select("lang", "kind", "key", "site").join(verdicts, ["lang", "kind", "key"])
    return known.groupBy("site", "key").agg(F.max_by("verdict", "n").alias("verdict"))


def furniture(text: str, url: str | None, site: str, known: dict[int, str]) -> list[int]:
    """Line numbers (from 1) of a body that are furniture, given the verdicts of its site."""
    lines = text.split("\n")
    names = [label(line, site) for line in lines]
    head = headline_at(lines, url)
    kind: list[str] = []
    guessed: list[int] = []
    for i, name in enumerate(names):
        if i == head:
            kind.append("main")
        elif not name:
            kind.append("blank")
        else:
            full, *slots = [known.get(code(k)) for k in keys_of(name)]
            if full == "t" or (full != "C" and "t" in slots and len(lines[i]) < 1.6 * PARAGRAPH) or _MARKS.search(name):
                kind.append("template")
                if full != "t":
                    guessed.append(i)
            else:
                kind.append("content" if full in ("c", "C") else "open")
    # a list of links: short open lines behind a head, up to a sentence, a stock line or a paragraph
    i = 0
    while i < len(lines):
        if kind[i] == "template" and known.get(code(">" + names[i])) == "h":
            j = i + 1
            while j < len(lines) and (kind[j] in ("open", "content") or j in guessed) and len(lines[j]) < PARAGRAPH and not _END.search(lines[j]):
                stock = known.get(code("=" + names[j])) == "C" and names[j].count(" ") < 4
                if stock or _BULLET.match(lines[j]):
                    break
                kind[j] = "item"
                j += 1
            i = j
        else:
            i += 1
    # rows of links above the first paragraph or below the last
    long = [i for i, line in enumerate(lines) if len(line) >= PARAGRAPH and kind[i] in ("open", "content")]
    for i, line in enumerate(lines):
        if kind[i] == "open" and (not long or i < long[0] or i > long[-1]) and _ROW.match(line):
            kind[i] = "template"
    # behind the last paragraph, short open lines that follow the frame belong to it, as do those before the headline
    for i in range(long[-1] + 1 if long else len(lines), len(lines)):
        if i and kind[i] == "open" and kind[i - 1] in ("template", "item") and len(lines[i]) < PARAGRAPH and not _END.search(lines[i]):
            kind[i] = "item"
    if head > 0:
        for i in range(head):
            if kind[i] == "open" and len(lines[i]) < PARAGRAPH:
                kind[i] = "template"
    if not any(k in ("open", "content") for k in kind):  # something stands for the main text
        for i in guessed:
            kind[i] = "open"
    return [i + 1 for i, k in enumerate(kind) if k in ("template", "item")]


def _by_site(bodies: DataFrame, emit, schema: str, columns: list[str], chunk: int) -> DataFrame:
    """emit(page row, furniture lines) for every body, with the verdicts of its site at hand.

    Bodies and verdicts meet by site, in groups of bounded size: a site with more than
    max(chunk, bodies / 65536) bodies is split by a hash of the id; such sites number
    at most 65536, so their list is broadcast."""
    need(bodies, ["body_id", "url", "text"])
    ship(bodies.sparkSession)
    own = bodies.select("body_id", "url", "text", *columns).where("length(text) > 0")
    verdicts = cut(induce(own))
    own = own.withColumn("site", site_column(F.col("url")))
    sizes = own.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    limit = max(chunk, own.count() // 65536)
    big = cut(sizes.where(F.col("n") > limit).select("site", F.ceil(F.col("n") / limit).cast("int").alias("k")))
    parts = own.join(F.broadcast(big), "site", "left").withColumn("part", F.pmod(F.xxhash64("body_id"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    rules = verdicts.join(F.broadcast(big), "site", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    n = spread(bodies)
    parts, rules = parts.repartition(n, "site", "part"), rules.repartition(n, "site", "part")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def mark(key: tuple, pages: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        verdict = dict(zip(known["key"], known["verdict"], strict=True))
        rows = [x for page in pages.itertuples(index=False) for x in emit(page, furniture(page.text, page.url, key[0], verdict))]
        return pd.DataFrame(rows, columns=names)

    return parts.groupBy("site", "part").cogroup(rules.groupBy("site", "part")).applyInPandas(mark, schema)


def find_furniture(bodies: DataFrame, chunk: int = 1000) -> DataFrame:
    """(body_id, line_no): the lines of each body that are furniture; the rest is its main text.

    Null and empty texts give no row, empty lines are no furniture; bodies without
    a usable url form one site without a name; repeated rows give repeated results.
    """
    kind = dict(bodies.dtypes)["body_id"]
    return _by_site(bodies, lambda page, lines: [(page.body_id, n) for n in lines], f"body_id {kind}, line_no int", [], chunk)


def main_texts(bodies: DataFrame, chunk: int = 1000) -> DataFrame:
    """(body_id, site, http_status, title, text) of each body with its main text; title tells whether a
    line spells the last part of the url. Cases as in find_furniture; a body of furniture only has the text ''."""
    kind = dict(bodies.dtypes)["body_id"]

    def emit(page, frame: list[int]):
        lines, skip = page.text.split("\n"), set(frame)
        status = None if page.http_status is None or page.http_status != page.http_status else int(page.http_status)
        yield page.body_id, page.site, status, headline_at(lines, page.url) >= 0, "\n".join(x for i, x in enumerate(lines, 1) if i not in skip)

    return _by_site(bodies, emit, f"body_id {kind}, site string, http_status int, title boolean, text string", ["http_status"], chunk)
