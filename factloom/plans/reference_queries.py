"""Queries of the engine's own operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.operators import hypotheses as H
from factloom.operators import links as L
from factloom.session import big_rank, salted_join, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def values_sql(rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def plus(spark: SparkSession, sf_dir: str, source: str, key: str, column: str, rows: list[tuple]) -> DataFrame:
    """Key and one text column of a whole table, and further rows that meet the cases which the table lacks."""
    df = table(spark, sf_dir, source).select(key, column)
    return df.unionByName(spark.createDataFrame(rows, f"{key} {dict(df.dtypes)[key]}, {column} string"))


def plus_sql(source: str, key: str, column: str, rows: list[tuple]) -> str:
    return f"(select {key}, {column} from {source} union all {values_sql(rows)}) as {source}"


def scalar(name: str, source: str, key: str, columns: Callable[[], dict[str, Column]], sql: str, extra: tuple[str, list[tuple]] | None = None) -> None:
    """A query of one narrow projection: the key and computed columns of a whole table, with the ``extra`` (column, rows) if given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plus(spark, sf_dir, source, key, *extra) if extra else table(spark, sf_dir, source)
        return df.select(key, *[c.alias(n) for n, c in columns().items()])

    query(sql.replace(f"from {source}", f"from {plus_sql(source, key, *extra)}") if extra else sql, name)(run)


#: Urls of the sites that the rules name, as the tables hold invented hosts only.
URLS = ("url", [(-1 - i, u) for i, u in enumerate((
    "https://www.quora.com/Is-this-tea-good/answer/Jane-Doe#c", "https://quora.com/Is-this-tea-good/answer/Jane-Doe?x=1", "https://www.quora.com/Best-indian-tea/", "https://foo.substack.com/p/an-essay?utm_source=1#x", "https://substack.com/@x",
    "https://www.tiktok.com/@some.one/video/7123456789?x=1", "https://www.tiktok.com/discover/best-green-tea", "https://www.tiktok.com/tag/tea_time", "https://www.youtube.com/watch?a=1&v=abcdefghijk&t=3", "https://www.youtube.com/shorts/ABCDEFGHIJK",
    "https://youtu.be/abc_EFGH-jk?si=2", "https://www.youtube.com/embed/abcdefghijk", "https://www.amazon.in/dp/B0", "https://www.flipkart.com/item", "https://blinkit.com/x", "https://www.trustpilot.com/review/a", "https://www.makemytrip.com/x",
    "https://www.99acres.com/x", "https://www.justdial.com/x", "https://www.etsy.com/x", "https://www.reddit.com/r/india/comments/1", "https://www.reddit.com/r/tea/comments/2", "https://shop.example.in/a", "https://www.ndtv.com:443/x//y/?b=2&a=1&utm_id=3",
    "HTTP://User@Example.COM:8080/a%20b/?q=x+y&q=&z", "ftp://a.example", "no scheme", "", None,
))])


def alts(words: list[str]) -> str:
    return U.alternatives(words)


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


c = F.col

def strip_sql_blank(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


# --- URL parts in SQL ---------------------------------------------------------------------------
_P = U.SPLIT
_HOST = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({u}, '" + _P + r"', 2)), '^.*@', ''), ':\d*$', ''), '^www\.', ''), '')"


def host_sql(u: str = "url") -> str:
    return _HOST.format(u=u).replace("{{", "{").replace("}}", "}")


def _enc(x: str) -> str:
    return f"replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"


CANON = rf"""
p0 as (select * replace (regexp_replace(url, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as url) from links),
pu as (select *, regexp_extract(url, '{_P}', 1) as _s, regexp_extract(url, '{_P}', 2) as _n, regexp_extract(url, '{_P}', 3) as _p, regexp_extract(url, '{_P}', 4) as _q,
  {host_sql()} as _h from p0),
pq as (select *, regexp_extract(_n, ':(\d+)$', 1) as _port,
  array_to_string(list_transform(list_sort(list_filter(list_transform(list_filter(string_split(_q, '&'), lambda p: regexp_matches(p, '^[^=]+=.+$')),
    lambda p: struct_pack(k := {_enc("split_part(p, '=', 1)")}, v := {_enc("regexp_replace(p, '^[^=]*=', '')")})), lambda s: lower(s.k) not in ({quoted(U.TRACKING)}))),
    lambda s: s.k || '=' || s.v), '&') as _qq,
  regexp_replace(case when _p = '' then '/' else _p end, '/{{2,}}', '/', 'g') as _pp from pu),
cl as (select * exclude (_s, _n, _p, _q, _h, _port, _qq, _pp), case when url is null then '' when _s = '' then trim(url) else
  lower(_s) || '://' || coalesce(_h, '') || case when _port <> '' and not (lower(_s) = 'https' and _port = '443') and not (lower(_s) = 'http' and _port = '80') then ':' || _port else '' end
  || case when length(_pp) > 1 then regexp_replace(_pp, '/+$', '') else _pp end || case when coalesce(_qq, '') <> '' then '?' || _qq else '' end end as canon from pq)"""

scalar("canonical_url", "links", "link_id", lambda: {"canon": U.canonical_url(c("url"))}, f"with {CANON} select link_id, canon from cl", extra=URLS)
scalar("host_path", "links", "link_id", lambda: {"host": U.host_of(c("url")), "path": U.path_of(c("url"))}, f"with t as (select link_id, {strip_sql_blank('url')} as url from links) select link_id, {host_sql()} as host, lower(regexp_extract(url, '{_P}', 3)) as path from t", extra=URLS)

_GEO = rf"""case when {host_sql()} is null then 'unknown' when regexp_matches({host_sql()}, '(?:{alts(U.INDIA_TLDS)})$') or regexp_matches({host_sql()}, '(?:^|\.)(?:{alts(U.INDIA_HOSTS)})$')
 or (contains({host_sql()}, 'reddit.com') and regexp_extract(lower(regexp_extract(url, '{_P}', 3)), '/r/([a-z0-9_]+)', 1) in ({quoted(U.INDIA_SUBREDDITS)}))
 or (contains({host_sql()}, 'quora.com') and regexp_matches(lower(regexp_extract(url, '{_P}', 3)), '{alts(U.QUORA_TOKENS)}')) then 'india' else 'row' end"""
scalar("classify_geo", "links", "link_id", lambda: {"scope": U.geo_scope(c("url"))}, f"select link_id, {_GEO} as scope from links", extra=URLS)


@query("select coalesce(geo_scope, 'unknown') as geo_scope, count(*) as n from links group by 1")
def geo_counts(spark, sf_dir):
    return table(spark, sf_dir, "links").groupBy(F.coalesce("geo_scope", F.lit("unknown")).alias("geo_scope")).agg(F.count(F.lit(1)).alias("n"))


_CLASS = "case " + " ".join(f"when regexp_matches(regexp_extract(lower(url), '^https?://([^/]+)/', 1), '(?:{alts(h.split())})$') then '{n}'" for n, h in U.SITE_CLASSES.items()) + " else 'other' end"
scalar("host_category", "links", "link_id", lambda: {"host_class": U.site_class(c("url"))}, f"select link_id, {_CLASS} as host_class from links", extra=URLS)


@query(f"select link_id from {plus_sql('links', 'link_id', *URLS)} where {_CLASS} <> 'other'")
def is_marketplace_url(spark, sf_dir):
    return plus(spark, sf_dir, "links", "link_id", *URLS).where(U.site_class(c("url")) != "other").select("link_id")


@query(rf"""select link_id from {plus_sql('links', 'link_id', *URLS)} where coalesce(url, '') <> '' and not regexp_matches(regexp_replace(split_part(regexp_replace(lower(url), '^https?://', ''), '/', 1), '^www\.', ''), '(?:^|\.)(?:{alts(U.WEB_EXCLUDED)})$')""")
def google_web_excluded(spark, sf_dir):
    return plus(spark, sf_dir, "links", "link_id", *URLS).where(~U.web_excluded(c("url"))).select("link_id")


scalar("canonical_quora", "links", "link_id", lambda: {"question_url": U.canonical_question(c("url"))}, r"select link_id, regexp_replace(regexp_replace(split_part(url, '#', 1), '(?i)/answer/[^/?#]+(/?$|/?\?)', '\1'), '/+$', '') as question_url from links", extra=URLS)
scalar(
    "substack_essay", "links", "link_id", lambda: {"essay": U.essay_url(c("url"))},
    r"select link_id, case when regexp_matches(url, '(?i)^https?://(?:[a-z0-9-]+\.)?substack\.com/') and regexp_matches(url, '(?i)/p/[^/?#]+') then regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') end as essay from links", URLS,
)
scalar(
    "tiktok_parse", "links", "link_id", lambda: {"kind": U.clip_parts(c("url"))[0], "clip_url": U.clip_parts(c("url"))[1], "creator": U.clip_creator(c("url")), "slug_tag": U.clip_tag(c("url"))},
    "with a as (select link_id, " + ", ".join(f"regexp_extract(url, '{p}', 1) as {k}" for k, p in U._CLIP.items()) + f", regexp_extract(url, '{U._CLIP['video']}', 2) as vid from links) "
    "select link_id, case when video <> '' then 'video' when discover <> '' then 'discover' when tag <> '' then 'tag' end as kind, case when video <> '' then 'https://www.tiktok.com/@' || video || '/video/' || vid "
    "when discover <> '' then 'https://www.tiktok.com/discover/' || discover when tag <> '' then 'https://www.tiktok.com/tag/' || tag end as clip_url, nullif(video, '') as creator, "
    "case when video <> '' then null else nullif(lower(replace(replace(case when discover <> '' then discover else tag end, '-', ''), '_', '')), '') end as slug_tag from a", URLS,
)


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[\s\p{{Z}}]+', ' ', 'g'))"


def hash_sql(title: str, body: str) -> str:
    both = rf"regexp_replace({norm_sql(title)} || chr(10) || {norm_sql(f'substr({body}, 1, 200)')}, '^\s+|\s+$', '', 'g')"
    return f"case when length({both}) >= 16 then substr(sha1({both}), 1, 16) end"


scalar("normalise_text", "links", "link_id", lambda: {"title": T.normalise(c("title"))}, f"select link_id, {norm_sql('title')} as title from links")
scalar("content_hash", "links", "link_id", lambda: {"content_hash": T.content_hash(c("title"), c("snippet"))}, f"select link_id, {hash_sql('title', 'snippet')} as content_hash from links")


@query(f"select l.link_id, {hash_sql('title', 'coalesce(nullif(caption, chr(0)), snippet)').replace('nullif(caption, chr(0))', 'nullif(caption, ' + chr(39) * 2 + ')')} as content_hash from links l left join short_videos v on v.link_id = l.link_id")
def content_hash_captions(spark, sf_dir):
    links, videos = table(spark, sf_dir, "links").select("link_id", "title", "snippet"), table(spark, sf_dir, "short_videos").select("link_id", "caption")
    joined = links.join(videos, "link_id", "left")
    return joined.select("link_id", T.content_hash(c("title"), F.coalesce(F.nullif("caption", F.lit("")), c("snippet"))).alias("content_hash"))


_TAGS = r"#([A-Za-z0-9_À-ɏḀ-ỿ]+)"


@query(rf"""with t as (select link_id, list_transform(regexp_extract_all(caption, '{_TAGS}', 1), lambda x: lower(x)) as l from short_videos),
p as (select link_id, unnest(l) as tag, generate_subscripts(l, 1) as i from t), f as (select link_id, tag, min(i) as i from p group by 1, 2)
select link_id, row_number() over (partition by link_id order by i) - 1 as pos, tag from f""")
def extract_hashtags(spark, sf_dir):
    tags = table(spark, sf_dir, "short_videos").select("link_id", F.posexplode(T.hashtags(c("caption"))).alias("pos", "tag"))
    return tags.select("link_id", c("pos").cast("bigint"), "tag")


_ENG = "case when view_count > 0 then least(round_even((coalesce(like_count, 0) + 3 * coalesce(comment_count, 0)) / view_count, 6), 1.0) end"
scalar("engagement_score", "links", "link_id", lambda: {"score": T.engagement(c("view_count"), c("like_count"), c("comment_count"))}, f"select link_id, {_ENG} as score from links")
CLOCKS = ("text", [(-1, "3:05"), (-2, "see (1:02:03) there"), (-3, "at 12:34"), (-4, "12:345"), (-5, "a1:23"), (-6, None), (-7, "")])
_CLOCK = r"(?:^|[\s(])(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[\s)]|$)"
scalar(
    "parse_duration_text", "documents", "doc_id", lambda: {"seconds": T.clock_seconds(c("text"))},
    rf"with a as (select doc_id, try_cast(regexp_extract(text, '{_CLOCK}', 1) as int) as a, try_cast(regexp_extract(text, '{_CLOCK}', 2) as int) as b, try_cast(regexp_extract(text, '{_CLOCK}', 3) as int) as d from documents) select doc_id, case when a is null then null when d is null then a * 60 + b else a * 3600 + b * 60 + d end as seconds from a", CLOCKS,
)
scalar("extract_video_id", "links", "link_id", lambda: {"video": T.video_id(c("url"))}, r"""select link_id, coalesce(nullif(regexp_extract(url, '(?i)youtube\.com/watch\?(?:[^#]*?&)?v=([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, '(?i)youtube\.com/shorts/([A-Za-z0-9_-]{11})', 1), ''),
 nullif(regexp_extract(url, '(?i)youtube\.com/embed/([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, '(?i)youtu\.be/([A-Za-z0-9_-]{11})', 1), '')) as video from links""", extra=URLS)


@query("select link_id, is_short_video and (contains(coalesce(url, ''), '/shorts/') or duration_sec is null or duration_sec <= 180) as short_shape, not contains(coalesce(url, ''), '/shorts/') and (duration_sec is null or duration_sec > 60) as long_shape from links where is_short_video is not null")
def youtube_shape_filter(spark, sf_dir):
    short = F.coalesce("url", F.lit("")).contains("/shorts/")
    d = c("duration_sec")
    return table(spark, sf_dir, "links").where("is_short_video is not null").select("link_id", (c("is_short_video") & (short | d.isNull() | (d <= 180))).alias("short_shape"), (~short & (d.isNull() | (d > 60))).alias("long_shape"))


def strip_sql(x: str, dropped: list[str], inside_body: bool = False) -> str:
    for tag in dropped:  # no back-references in this dialect: one pass an element
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    if inside_body:
        x = f"coalesce(nullif(regexp_extract({x}, '(?is)<body[^>]*>(.*?)</body>', 1), ''), {x})"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in T._ENTITIES:
        q = b.replace("'", "''")
        x = f"replace({x}, '{a}', '{q}')"
    return rf"trim(regexp_replace(regexp_replace({x}, '&[a-zA-Z]+;', ' ', 'g'), '\s+', ' ', 'g'))"


#: Markup, entities and dropped elements, as the bodies hold almost none.
MARKUP = ("text", [(-1 - i, t) for i, t in enumerate((
    "<html><head><style>p {a}</style></head><body><nav>Menu</nav><p>One &amp; two</p><script>x < 1</script><footer>Foot</footer></body></html>", "<p>a&nbsp;b&quot;c&#39;d&lt;e&gt;</p>", "<aside>x</aside><form>y</form>left<noscript>z</noscript>",
    "&copy; plain &hellip; text", "<BODY class=a>In <b>side</b></BODY> out", "", None,
))])
scalar("strip_html_triage", "bodies", "body_id", lambda: {"plain": T.strip_html(c("text"))}, f"select body_id, {strip_sql('text', ['script', 'style'])} as plain from bodies", MARKUP)
scalar("strip_html_body", "bodies", "body_id", lambda: {"plain": T.strip_html(c("text"), "script|style|nav|footer|aside|form|noscript", True)}, f"select body_id, {strip_sql('text', ['script', 'style', 'nav', 'footer', 'aside', 'form', 'noscript'], True)} as plain from bodies", MARKUP)

_SHORT_SQL = "concat_ws(chr(10), nullif(l.title, ''), case when v.caption <> '' and v.caption is distinct from l.title then v.caption end, case when len(v.top_comments) > 0 then 'Top comments: ' || array_to_string(v.top_comments, ' // ') end, case when v.transcript <> '' then 'Transcript: ' || v.transcript end)"


@query(f"select l.link_id, substr({_SHORT_SQL}, 1, 1500) as evidence from links l join short_videos v using (link_id)")
def short_video_text(spark, sf_dir):
    links, videos = table(spark, sf_dir, "links").select("link_id", "title"), table(spark, sf_dir, "short_videos").select("link_id", "caption", "top_comments", "transcript")
    j = links.join(videos, "link_id")
    comments = F.when(F.size("top_comments") > 0, F.concat(F.lit("Top comments: "), F.array_join("top_comments", " // ")))
    said = F.when(c("transcript") != "", F.concat(F.lit("Transcript: "), c("transcript")))
    caption = F.when((c("caption") != "") & ~c("caption").eqNullSafe(c("title")), c("caption"))
    return j.select("link_id", F.substring(F.concat_ws("\n", F.nullif("title", F.lit("")), caption, comments, said), 1, 1500).alias("evidence"))


_BODY = "body1 as (select url, min_by(text, body_id) as text from bodies where text <> '' group by url)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link_id, evidence): title and snippet, then the fetched body in what a budget of 1500 characters leaves."""
    links = table(spark, sf_dir, "links").select("link_id", "url", F.concat_ws(" — ", F.nullif("title", F.lit("")), F.nullif("snippet", F.lit(""))).alias("anchor"))
    bodies = table(spark, sf_dir, "bodies").where("text <> ''").groupBy("url").agg(F.min_by("text", "body_id").alias("body"))
    cut = F.expr("substring(body, 1, greatest(0, 1500 - length(anchor) - 8))")
    whole = F.when((c("anchor") != "") & (F.coalesce(cut, F.lit("")) != ""), F.concat("anchor", F.lit("\n"), cut)).otherwise(F.coalesce(F.nullif(cut, F.lit("")), c("anchor")))
    return links.join(bodies, "url", "left").select("link_id", F.substring(whole, 1, 1500).alias("evidence"))


_EVIDENCE = f"{_BODY}, ev0 as (select link_id, concat_ws(' — ', nullif(title, ''), nullif(snippet, '')) as anchor, b.text as body from links l left join body1 b on b.url = l.url), ev1 as (select link_id, anchor, substr(body, 1, greatest(0, 1500 - length(anchor) - 8)) as cut from ev0), ev as (select link_id, substr(case when anchor <> '' and coalesce(cut, '') <> '' then anchor || chr(10) || cut else coalesce(nullif(cut, ''), anchor) end, 1, 1500) as evidence from ev1)"
query(f"with {_EVIDENCE} select link_id, evidence from ev", "evidence_text")(evidence)

# --- windows --------------------------------------------------------------------------------------
_DAYS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365, "5y": 1825}
_BANDS = ((1, "pd", "d", "qdr:d", "day"), (7, "pw", "w", "qdr:w", "week"), (31, "pm", "m", "qdr:m", "month"), (90, "py", "y", "qdr:m3", "year"), (365, "py", "y", "qdr:y", "year"))


@query(
    "with d as (select hypothesis_id, case trim(window_label) " + " ".join(f"when '{k}' then {v}" for k, v in _DAYS.items()) + " end as days from hypotheses) select hypothesis_id, days, "
    + ", ".join("case " + " ".join(f"when days <= {b[0]} then '{b[i]}'" for b in _BANDS) + f" when days is not null then '{e}' end as {n}" for i, n, e in ((1, "freshness", ""), (2, "timelimit", ""), (3, "tbs", "cdr:1"), (4, "period", "all"))) + " from d"
)
def time_params(spark, sf_dir):
    label = F.trim("window_label")
    days = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in _DAYS.items()])
    out = table(spark, sf_dir, "hypotheses").select("hypothesis_id", days.alias("days"))

    def band(i: int, beyond: str) -> Column:
        e = None
        for b in _BANDS:
            e = F.when(c("days") <= b[0], b[i]) if e is None else e.when(c("days") <= b[0], b[i])
        return e.when(c("days").isNotNull(), beyond)

    return out.select("hypothesis_id", "days", band(1, "").alias("freshness"), band(2, "").alias("timelimit"), band(3, "cdr:1").alias("tbs"), band(4, "all").alias("period"))


@query("select link_id from links where observed_at is null or observed_at between timestamptz '2025-01-15 00:00:00+00' and timestamptz '2025-03-31 23:59:59+00'")
def window_filter(spark, sf_dir):
    at = c("observed_at")
    return table(spark, sf_dir, "links").where(at.isNull() | at.between(F.to_timestamp(F.lit("2025-01-15 00:00:00")), F.to_timestamp(F.lit("2025-03-31 23:59:59")))).select("link_id")


_CODES = "case " + " ".join(f"when g = '{k}' then '{v}'" for k, v in H.GEO_CODES.items()) + " else '' end"
scalar("normalize_geo", "links", "link_id", lambda: {"geo": H.geo_code(c("geo_scope"))}, f"with a as (select link_id, lower(trim(geo_scope)) as g from links) select link_id, case when regexp_matches(g, '^[a-z]{{2}}$') then upper(g) else {_CODES} end as geo from a")

# --- hypotheses -----------------------------------------------------------------------------------
_CELL = """list_filter(list_transform(case when contains({x}, '|') then string_split({x}, '|') when contains({x}, ';') then string_split({x}, ';') when contains({x}, ',') and not (starts_with({x}, '[') and ends_with({x}, ']')) then string_split({x}, ',')
 else [regexp_replace({x}, '^\\[+|\\]+$', '', 'g')] end, lambda p: regexp_replace(p, '^[\\s"'']+|[\\s"'']+$', '', 'g')), lambda p: p <> '')"""
_SIGNALS = f"sig as (select hypothesis_id, unnest(l) as signal, generate_subscripts(l, 1) - 1 as pos from (select hypothesis_id, {_CELL.format(x='trim(expected_signals)')} as l from hypotheses where expected_signals is not null))"


@query(f"with {_SIGNALS} select hypothesis_id, pos, signal from sig")
def split_list_cell(spark, sf_dir):
    return H.signal_rows(table(spark, sf_dir, "hypotheses")).select("hypothesis_id", c("pos").cast("bigint"), "signal")


_ARCH = "case " + " ".join(f"when contains(s, '{k}') then '{H.ARCHETYPES[k]}'" for k in sorted(H.ARCHETYPES, key=lambda k: -len(k))) + " else 'other' end"


@query(f"with {_SIGNALS} select hypothesis_id, pos, {_ARCH} as archetype from (select *, lower(replace(signal, '_', ' ')) as s from sig)")
def signal_archetype(spark, sf_dir):
    return H.signal_rows(table(spark, sf_dir, "hypotheses")).select("hypothesis_id", c("pos").cast("bigint"), H.archetype(c("signal")).alias("archetype"))


@query("select distinct least(a.hypothesis_id, b.hypothesis_id) as id_a, greatest(a.hypothesis_id, b.hypothesis_id) as id_b from hypotheses a join hypotheses b on b.hypothesis_id = a.contrarian_pair_id where a.hypothesis_id <> b.hypothesis_id")
def detect_pairs(spark, sf_dir):
    return H.pairs(table(spark, sf_dir, "hypotheses"))


@query(f"with t as (select row_id, {strip_sql_blank("regexp_extract(raw_line, '([^,]*)$', 1)")} as x from hypothesis_lines) select row_id, case when regexp_matches(x, '^[+-]?[0-9]+$') then try_cast(x as int) end as last_int from t")
def try_int(spark, sf_dir):
    return table(spark, sf_dir, "hypothesis_lines").select("row_id", U.strip(F.regexp_extract("raw_line", "([^,]*)$", 1)).try_cast("int").alias("last_int"))


_HTEXT = "lower(concat_ws(' ', statement, rationale, core_problem_statement))"


def lex_sql(terms: list[str], ordered: bool = False) -> str:
    words = r"regexp_split_to_array(t, '[^\p{L}\p{N}_]+')"
    if ordered:
        return f"array_to_string(list_filter([{quoted(terms)}], lambda x: case when regexp_matches(x, '[ -]') then contains(t, x) else list_contains({words}, x) end), ',')"
    one, many = [t for t in terms if " " not in t and "-" not in t], [t for t in terms if " " in t or "-" in t]
    more = f", list_filter([{quoted(many)}], lambda x: contains(t, x))" if many else ", []::varchar[]"
    return f"array_to_string(list_sort(list_concat(list_filter([{quoted(one)}], lambda x: list_contains({words}, x)){more})), ',')"


def _htext() -> Column:
    return F.concat_ws(" ", "statement", "rationale", "core_problem_statement")


scalar(
    "scan_lexicon", "hypotheses", "hypothesis_id", lambda: {"pains": F.array_join(H.lexicon_hits(_htext(), H.PAINS), ","), "aspirations": F.array_join(H.lexicon_hits(_htext(), H.ASPIRATIONS), ",")},
    f"with h as (select hypothesis_id, {_HTEXT} as t from hypotheses) select hypothesis_id, {lex_sql(H.PAINS)} as pains, {lex_sql(H.ASPIRATIONS)} as aspirations from h",
)
scalar(
    "scan_identity", "hypotheses", "hypothesis_id", lambda: {"identities": F.array_join(H.lexicon_hits(_htext(), H.IDENTITIES, True), ",")},
    f"with h as (select hypothesis_id, {_HTEXT} as t from hypotheses) select hypothesis_id, {lex_sql(H.IDENTITIES, True)} as identities from h",
)
PLACED = ("statement", [("~1", "Buyers in New Delhi and Mumbai, and Indian shoppers abroad"), ("~2", "the US and south asian markets"), ("~3", None)])
scalar(
    "scan_geo", "hypotheses", "hypothesis_id", lambda: {"places": F.array_join(H.lexicon_hits(c("statement"), sorted(H.PLACES, key=lambda t: (-len(t), t)), True), ",")},
    f"with h as (select hypothesis_id, lower(coalesce(statement, '')) as t from hypotheses) select hypothesis_id, {lex_sql(sorted(H.PLACES, key=lambda t: (-len(t), t)), True)} as places from h", PLACED,
)


def terms_sql(cell: str) -> str:
    return f"list_filter(flatten(list_transform({_CELL.format(x=f'trim({cell})')}, lambda s: regexp_split_to_array(lower(s), '[_\\s/]+'))), lambda w: w <> '' and w not in ({quoted(T.STOPWORDS)}))"


@query(f"""with h as (select hypothesis_id, {terms_sql('expected_signals')} as l from hypotheses where expected_signals is not null), p as (select hypothesis_id, unnest(l) as term, generate_subscripts(l, 1) as i from h),
f as (select hypothesis_id, term, min(i) as i from p group by 1, 2) select hypothesis_id, row_number() over (partition by hypothesis_id order by i) - 1 as pos, term from f""")
def terms_from_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "hypotheses").select("hypothesis_id", F.posexplode(T.signal_terms(T.list_cell(c("expected_signals")))).alias("pos", "term"))
    return rows.select("hypothesis_id", c("pos").cast("bigint"), "term")


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = {n: T.term_pattern(T.signal_terms(T.list_cell(c(f)))) for n, f in (("sig", "expected_signals"), ("ctr", "expected_counter_signals"))}
    return table(spark, sf_dir, "hypotheses").select("hypothesis_id", *[p.alias(n) for n, p in both.items()])


def _pattern_sql(cell: str) -> str:
    plain = f"list_filter(list_transform({terms_sql(cell)}, lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\-]', '', 'g')), lambda t: t <> '')"
    return f"case when len({plain}) > 0 then '(?i)\\b(' || array_to_string({plain}, '|') || ')(?:s|es|ed|ing|er|ers|ly)?\\b' end"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the hit rates of their hypothesis's signals and counter-signals in the evidence text. One hypothesis
    may hold a tenth of the links, so the join is salted."""
    links = table(spark, sf_dir, "links").select("link_id", "hypothesis_id", "channel", "is_short_video", "view_count", "like_count", "comment_count")
    with_text = links.join(evidence(spark, sf_dir), "link_id")
    joined = salted_join(with_text, _patterns(spark, sf_dir), "hypothesis_id", c("link_id"))
    return joined.withColumns({"sig_rate": T.hit_rate(c("evidence"), c("sig")), "ctr_rate": T.hit_rate(c("evidence"), c("ctr"))}).drop("sig", "ctr")


_WORDS = r"greatest(len(regexp_extract_all(evidence, '[\p{L}\p{N}_]+')), 1)"
_RATES = f"""{_EVIDENCE}, pat as (select hypothesis_id, {_pattern_sql('expected_signals')} as sig, {_pattern_sql('expected_counter_signals')} as ctr from hypotheses),
rt as (select l.link_id, l.hypothesis_id, l.channel, l.is_short_video, l.view_count, l.like_count, l.comment_count, evidence, coalesce(least(len(regexp_extract_all(evidence, sig)) / {_WORDS}, 1.0), 0.0) as sig_rate, coalesce(least(len(regexp_extract_all(evidence, ctr)) / {_WORDS}, 1.0), 0.0) as ctr_rate
 from links l join ev using (link_id) left join pat on pat.hypothesis_id = l.hypothesis_id)"""


@query(f"with {_RATES} select link_id, round(sig_rate, 9) as sig_rate, round(ctr_rate, 9) as ctr_rate from rt")
def hit_rate(spark, sf_dir):
    return rates(spark, sf_dir).select("link_id", F.round("sig_rate", 9).alias("sig_rate"), F.round("ctr_rate", 9).alias("ctr_rate"))


_VERDICT = "case when evidence = '' then 'tangential' when ctr_rate > sig_rate and ctr_rate > 0 then 'refutes' when sig_rate > 0 then 'supports' else 'tangential' end"
_JUDGED = f"{_RATES}, vd as (select *, {_VERDICT} as found from rt), jd as (select *, case found when 'refutes' then least(0.85, 0.5 + ctr_rate * 25) when 'supports' then least(0.85, 0.5 + sig_rate * 25) else 0.3 end as sure from vd)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, sure = T.verdict(c("evidence"), c("sig_rate"), c("ctr_rate"))
    return rates(spark, sf_dir).withColumn("found", found).withColumn("sure", T.verdict(c("evidence"), c("sig_rate"), c("ctr_rate"))[1])


@query(f"with {_JUDGED} select link_id, found as verdict, round(sure, 6) as confidence from jd")
def deterministic_verdict(spark, sf_dir):
    return judged(spark, sf_dir).select("link_id", c("found").alias("verdict"), F.round("sure", 6).alias("confidence"))


# --- ranking --------------------------------------------------------------------------------------
_RANK = f"ranked as (select *, row_number() over (partition by hypothesis_id, channel order by case when is_short_video then coalesce({_ENG}, 0.0) else 0.0 end desc, link_id) as rank_in_channel from links)"


@query(f"with {_RANK} select link_id, rank_in_channel from ranked")
def within_channel_rank(spark, sf_dir):
    """The whole order within each hypothesis and channel, numbered in parts as one hypothesis may hold a tenth of all rows."""
    scored = table(spark, sf_dir, "links").select("link_id", "hypothesis_id", "channel", (-L.channel_score()).alias("score"))
    return big_rank(scored, ["hypothesis_id", "channel"], [c("score"), c("link_id")], "rank_in_channel").select("link_id", "rank_in_channel")


_CUT = f"{_RANK}, cut as (select *, row_number() over (partition by hypothesis_id order by rank_in_channel, first_id) as cut_pos from (select *, min(link_id) over (partition by hypothesis_id, channel) as first_id from ranked) where channel is not null and hypothesis_id is not null)"


@query(f"with {_CUT} select hypothesis_id, link_id, cut_pos from cut where cut_pos <= 30")
def channel_balanced_cut(spark, sf_dir):
    links = table(spark, sf_dir, "links").where("channel is not null and hypothesis_id is not null")
    return L.balanced_cut(links).select("hypothesis_id", "link_id", c("cut_pos").cast("bigint"))


@query(f"with {_JUDGED}, {_CUT}, k as (select j.* from jd j join cut using (link_id) where cut_pos <= 30) select hypothesis_id, link_id, found as verdict, round(sure, 6) as confidence, row_number() over (partition by hypothesis_id order by case found when 'supports' then 0 when 'refutes' then 1 else 2 end, round(sure, 6) desc, link_id) as place from k")
def triage(spark, sf_dir):
    """Balanced cut, evidence, hit rates, verdicts and rank, for all hypotheses in one plan."""
    links = table(spark, sf_dir, "links").where("channel is not null and hypothesis_id is not null")
    kept = judged(spark, sf_dir).join(L.balanced_cut(links).select("link_id"), "link_id", "left_semi").withColumn("confidence", F.round("sure", 6))
    w = Window.partitionBy("hypothesis_id").orderBy(L.verdict_place(c("found")), F.desc("confidence"), "link_id")
    return kept.select("hypothesis_id", "link_id", c("found").alias("verdict"), "confidence", F.row_number().over(w).cast("bigint").alias("place"))


@query("select hypothesis_id, link_id, row_number() over (partition by hypothesis_id order by case verdict when 'supports' then 0 when 'refutes' then 1 else 2 end, coalesce(confidence, 0) desc, link_id) as place from links")
def verdict_rank(spark, sf_dir):
    """All links of each hypothesis in order of verdict, confidence and id."""
    keyed = table(spark, sf_dir, "links").select("hypothesis_id", "link_id", L.verdict_place(c("verdict")).alias("v"), (-F.coalesce("confidence", F.lit(0.0))).alias("o"))
    return big_rank(keyed, ["hypothesis_id"], [c("v"), c("o"), c("link_id")], "place").select("hypothesis_id", "link_id", "place")


@query("""with s as (select hypothesis_id, link_id, verdict, row_number() over (partition by hypothesis_id, verdict order by confidence desc nulls last, link_id) as n from links where verdict in ('supports', 'refutes', 'tangential')),
h as (select hypothesis_id, bool_or(verdict <> 'tangential') as sided from s group by 1) select s.hypothesis_id, link_id, verdict from s join h on h.hypothesis_id is not distinct from s.hypothesis_id where n <= 12 and (verdict <> 'tangential') = sided""")
def synthesis_candidates(spark, sf_dir):
    """The twelve surest links of each side of a hypothesis; tangential ones only where there is no side."""
    w = Window.partitionBy("hypothesis_id", "verdict").orderBy(F.desc_nulls_last("confidence"), "link_id")
    top = table(spark, sf_dir, "links").where(c("verdict").isin(*L.VERDICT_ORDER)).withColumn("n", F.row_number().over(w)).where("n <= 12")
    sided = F.bool_or(c("verdict") != "tangential").over(Window.partitionBy("hypothesis_id"))  # at most 36 rows a hypothesis by now
    return top.withColumn("sided", sided).where((c("verdict") != "tangential") == c("sided")).select("hypothesis_id", "link_id", "verdict")


# --- dedup and clusters -----------------------------------------------------------------------------
_KEY = f"lower({strip_sql_blank(f"coalesce(nullif({strip_sql_blank('canonical_url')}, ''), url)")})"


@query(f"select link_id from (select link_id, row_number() over (partition by hypothesis_id, channel, {_KEY} order by link_id) as n, {_KEY} as k from links) where n = 1 and k <> ''")
def url_dedup_first(spark, sf_dir):
    return L.first_urls(table(spark, sf_dir, "links").select("link_id", "hypothesis_id", "channel", "canonical_url", "url"), ["hypothesis_id", "channel"]).select("link_id")


@query(f"select hypothesis_id, min(link_id) as link_id, count(*) as n_seen from (select *, {_KEY} as k from links) where k <> '' group by hypothesis_id, k")
def discovered_csv(spark, sf_dir):
    keyed = table(spark, sf_dir, "links").select("link_id", "hypothesis_id", L.url_key(c("canonical_url"), c("url")).alias("k")).where("k <> ''")
    return keyed.groupBy("hypothesis_id", "k").agg(F.min("link_id").alias("link_id"), F.count(F.lit(1)).alias("n_seen")).drop("k")


@query("select count(distinct url) as added, count(*) - count(distinct url) as duplicates from links where url <> ''")
def pool_add(spark, sf_dir):
    urls = table(spark, sf_dir, "links").where("url <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return urls.agg(F.count(F.lit(1)).alias("added"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


_BK = "regexp_replace(lower(trim(backend_used)), '[\\s\\-]+', '_', 'g')"


@query(f"""with r as (select link_id, hypothesis_id, coalesce(nullif(trim(url), ''), chr(1) || link_id::varchar) as k, list_position(['headless_google', 'brave', 'duckduckgo', 'serpapi'], {_BK}) as rk from links),
b as (select hypothesis_id, k, rk, link_id, row_number() over (partition by hypothesis_id, k order by rk, link_id) as n from r where rk > 0), d as (select * from b where n = 1),
g as (select hypothesis_id, rk, count(*) as n from d group by 1, 2), s as (select *, coalesce(sum(n) over (partition by hypothesis_id order by rk rows between unbounded preceding and 1 preceding), 0) as before from g)
select d.hypothesis_id, d.link_id, d.rk as backend_rank from d join s using (hypothesis_id, rk) where before < 10""")
def fallback_union(spark, sf_dir):
    links = table(spark, sf_dir, "links").select("link_id", "hypothesis_id", "url", F.regexp_replace(F.lower(F.trim("backend_used")), r"[\s\-]+", "_").alias("backend"))
    return L.fallback_union(links, ["headless_google", "brave", "duckduckgo", "serpapi"], 10)


_RICH = "sv desc, views desc, rich desc, age desc, link_id"
_CLUSTERS = f"""{CANON.replace("'g') as url) from links)", "'g') as url) from (select * replace (coalesce(nullif(canonical_url, ''), url) as url) from links))").replace("p0 as", "ck0 as").replace("from p0", "from ck0").replace("pu as", "cku as").replace("from pu", "from cku").replace("pq as", "ckq as").replace("from pq", "from ckq").replace("cl as", "ckl as")},
cv as (select link_id, max(caption) as caption, max(coalesce((len(top_comments) > 0)::int, 0) + coalesce((transcript <> '')::int, 0)) as enriched from short_videos group by 1),
cb as (select l.link_id, hypothesis_id, coalesce(hypothesis_id, '') as sc, channel, discovered_at, canon as bucket, coalesce(is_short_video, false) as sv, case when is_short_video then coalesce(view_count, 0) else 0 end as views,
 case when is_short_video then coalesce(enriched, 0) else 0 end as rich, coalesce(-epoch_us(discovered_at), 0) as age, {hash_sql('title', "case when is_short_video then coalesce(nullif(caption, ''), snippet) else snippet end")} as h from ckl l left join cv using (link_id)),
cr as (select *, row_number() over (partition by sc, bucket order by {_RICH}) as n, min(link_id) over (partition by sc, bucket) as first from cb),
cn as (select sc, bucket, first, coalesce('h:' || h, 'u:' || bucket) as cluster from cr where n = 1),
cm as (select cb.*, cn.cluster, cn.first from cb join cn using (sc, bucket)),
cx as (select *, first_value(link_id) over (partition by sc, cluster order by {_RICH}) as representative from cm)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clusters(table(spark, sf_dir, "links"), videos=table(spark, sf_dir, "short_videos"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cluster_sizes(members(spark, sf_dir), table(spark, sf_dir, "links"))


@query(f"with {_CLUSTERS} select link_id, representative from cx")
def cluster_links(spark, sf_dir):
    return members(spark, sf_dir).select("link_id", "representative")


@query(f"with {_CLUSTERS}, k as (select sc, cluster, count(*) as n, count(distinct channel) as ch from cx group by 1, 2) select sc as hypothesis_id, sum(n)::bigint as input_links, count(*) as clusters, (sum(n) - count(*))::bigint as collapsed, count(*) filter (ch > 1) as cross_platform_clusters, round_even(sum(n) / count(*), 2) as compression_ratio from k group by 1")
def cluster_stats(spark, sf_dir):
    """Links, clusters, links that fell together, clusters over several channels, and links per cluster."""
    whole = sizes(spark, sf_dir).groupBy("hypothesis_id").agg(F.sum("size").alias("input_links"), F.count(F.lit(1)).alias("clusters"), F.count_if(c("n_channels") > 1).alias("cross_platform_clusters"))
    return whole.select("hypothesis_id", "input_links", "clusters", (c("input_links") - c("clusters")).alias("collapsed"), "cross_platform_clusters", F.bround(c("input_links") / c("clusters"), 2).alias("compression_ratio"))


@query(f"with {_CLUSTERS} select representative, count(*) as size, count(distinct channel) as n_channels, count(distinct channel) > 1 as cross_platform from cx group by 1")
def representative(spark, sf_dir):
    return sizes(spark, sf_dir).select("representative", "size", "n_channels", (c("n_channels") > 1).alias("cross_platform"))


@query(f"with {_CLUSTERS}, k as (select sc, representative, count(*) as size, min(first) as first, any_value(sv) filter (link_id = representative) as sv, max(views) filter (link_id = representative) as views, max(rich) filter (link_id = representative) as rich, max(age) filter (link_id = representative) as age from cx group by 1, 2) select sc as hypothesis_id, representative, size, row_number() over (partition by sc order by size desc, sv desc, views desc, rich desc, age desc, first) as place from k")
def cluster_order(spark, sf_dir):
    """All clusters of each hypothesis: larger ones first, then the richer representative, then the first seen."""
    links = L.with_videos(table(spark, sf_dir, "links"), table(spark, sf_dir, "short_videos"))
    heads = links.select(c("link_id").alias("representative"), L.representative_key().alias("key"))
    whole = sizes(spark, sf_dir).join(heads, "representative")
    order = [(-c("size")).alias("a"), (~c("key.short")).alias("b"), (-c("key.views")).alias("v"), (-c("key.enriched")).alias("e"), (-c("key.early")).alias("t"), c("ord.first").alias("f")]
    keyed = whole.select("hypothesis_id", "representative", "size", *order)
    return big_rank(keyed, ["hypothesis_id"], [c(x) for x in "abvetf"], "place").select("hypothesis_id", "representative", "size", "place")


@query(f"""with {_CLUSTERS}, o as (select representative, max(case when link_id = representative then channel end) as own from cx group by 1), f as (select representative, channel, min(first * 1000000000 + link_id) as i from cx where channel is not null group by 1, 2)
select representative, string_agg(channel, ',' order by i) as also_found_on from f join o using (representative) where channel is distinct from own group by 1""")
def also_found_on(spark, sf_dir):
    return L.also_found_on(members(spark, sf_dir), table(spark, sf_dir, "links"))


@query(f"""with {_CLUSTERS} select x.link_id, r.verdict, r.confidence, array_to_string(list_sort(list_distinct(list_concat(coalesce(m.signal_tags, []), coalesce(r.signal_tags, [])))), ',') as signal_tags
 from cx x join links r on r.link_id = x.representative join links m on m.link_id = x.link_id""")
def propagate_verdicts(spark, sf_dir):
    """Each link with the verdict of its cluster's representative, and the tags of both."""
    links = table(spark, sf_dir, "links")
    heads = links.select(c("link_id").alias("representative"), "verdict", "confidence", c("signal_tags").alias("theirs"))
    none = F.array().cast("array<string>")
    own = members(spark, sf_dir).select("link_id", "representative").join(links.select("link_id", "signal_tags"), "link_id")
    tags = F.array_join(F.array_sort(F.array_union(F.coalesce("signal_tags", none), F.coalesce("theirs", none))), ",")
    return own.join(heads, "representative").select("link_id", "verdict", "confidence", tags.alias("signal_tags"))


@query("select hypothesis_id, channel, min(link_id) as link_id, lower(trim(query_text)) as query_text from links where trim(query_text) <> '' group by hypothesis_id, channel, lower(trim(query_text))")
def query_text_dedup(spark, sf_dir):
    links = table(spark, sf_dir, "links").where("trim(query_text) <> ''").select("link_id", "hypothesis_id", "channel", F.lower(F.trim("query_text")).alias("query_text"))
    return links.groupBy("hypothesis_id", "channel", "query_text").agg(F.min("link_id").alias("link_id"))


@query("select hypothesis_id, channel from links where hypothesis_id is not null and channel is not null group by 1, 2 having not coalesce(bool_or(falsifier), false)")
def ensure_falsifier(spark, sf_dir):
    """Channels of a hypothesis without any falsifying query, to be given one."""
    links = table(spark, sf_dir, "links").where("hypothesis_id is not null and channel is not null")
    return links.groupBy("hypothesis_id", "channel").agg(F.bool_or("falsifier").alias("f")).where(~F.coalesce("f", F.lit(False))).drop("f")


@query("select hypothesis_id, channel from links where hypothesis_id is not null and channel is not null group by 1, 2 having coalesce(bool_or(falsifier), false) and bool_or(archetype in (1, 4))")
def channel_coverage(spark, sf_dir):
    links = table(spark, sf_dir, "links").where("hypothesis_id is not null and channel is not null")
    seen = links.groupBy("hypothesis_id", "channel").agg(F.bool_or("falsifier").alias("f"), F.bool_or(c("archetype").isin(1, 4)).alias("a"))
    return seen.where("f and a").select("hypothesis_id", "channel")


@query(f"with t as (select link_id, {strip_sql_blank('title')} as title from links) select min(link_id) as link_id from t where length(title) between 8 and 240 group by lower(title)")
def paa_noise(spark, sf_dir):
    links = table(spark, sf_dir, "links").select("link_id", U.strip(c("title")).alias("t")).where("length(t) between 8 and 240")
    return links.groupBy(F.lower("t").alias("k")).agg(F.min("link_id").alias("link_id")).select("link_id")


# --- aggregates -------------------------------------------------------------------------------------
@query("select hypothesis_id, count(*) filter (coalesce(verdict, 'tangential') = 'supports') as supports, count(*) filter (coalesce(verdict, 'tangential') = 'refutes') as refutes, count(*) filter (coalesce(verdict, 'tangential') not in ('supports', 'refutes')) as tangential from links group by 1")
def group_by_verdict(spark, sf_dir):
    v = F.coalesce("verdict", F.lit("tangential"))
    return table(spark, sf_dir, "links").groupBy("hypothesis_id").agg(F.count_if(v == "supports").alias("supports"), F.count_if(v == "refutes").alias("refutes"), F.count_if(~v.isin("supports", "refutes")).alias("tangential"))


@query(f"""with {CANON}, k as (select link_id, hypothesis_id, verdict, confidence, canon from cl), v as (select canon, verdict, count(*) as n, min(link_id) as f from k where verdict is not null group by 1, 2),
m as (select canon, verdict, row_number() over (partition by canon order by n desc, f) as p from v) select t.canon_md5 as url_key, n_hypotheses, n_links, confidence_max, m.verdict as verdict_majority from
(select canon, md5(canon) as canon_md5, count(distinct hypothesis_id) as n_hypotheses, count(*) as n_links, max(confidence) as confidence_max from k group by 1) t left join m on m.canon = t.canon and p = 1""")
def batch_url_rollup(spark, sf_dir):
    return L.url_rollup(table(spark, sf_dir, "links")).drop("representative")




@query("select l.link_id, l.hypothesis_id, h.core_problem_id, h.core_problem_statement from links l left join hypotheses h using (hypothesis_id)")
def batch_raw_csv(spark, sf_dir):
    links = table(spark, sf_dir, "links").select("link_id", "hypothesis_id")
    return salted_join(links, table(spark, sf_dir, "hypotheses").select("hypothesis_id", "core_problem_id", "core_problem_statement"), "hypothesis_id", c("link_id")).select("link_id", "hypothesis_id", "core_problem_id", "core_problem_statement")


# --- event state ------------------------------------------------------------------------------------
_FAIL = """f as (select user_id, event_id, ts, event_type = 'error' as bad, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events),
g as (select *, case when bad then row_number() over (partition by user_id, run, bad order by ts, event_id) else 0 end as streak from f)"""


@query(f"with {_FAIL}, l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from g) select user_id, streak as failures, case when streak > 0 then least(3600, 60 * power(2, least(streak, 10) - 1)) else 0 end::bigint as cooldown from l where n = 1")
def health_state(spark, sf_dir):
    """Consecutive failures and the doubled cooldown of each source after its last event (a fold by windows)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bad = c("event_type") == "error"
    runs = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", bad.alias("bad"), F.sum(F.when(~bad, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    last = runs.groupBy("user_id").agg(F.max("run").alias("run"))
    streak = runs.where("bad").join(last, ["user_id", "run"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("failures"))
    cool = F.when(c("failures") > 0, F.least(F.lit(3600.0), 60 * F.pow(F.lit(2.0), F.least("failures", F.lit(10)) - 1))).otherwise(0).cast("bigint")
    return last.select("user_id").join(streak, "user_id", "left").select("user_id", F.coalesce("failures", F.lit(0)).alias("failures")).select("user_id", "failures", cool.alias("cooldown"))


@query("select event_type, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from events group by 1")
def event_log(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("select user_id, event_type, count(*) as lookups, count(*) filter (gap is not null and gap <= 3600) as hits from (select user_id, event_type, epoch(ts - lag(ts) over (partition by user_id, event_type order by ts, event_id)) as gap from events) group by 1, 2")
def ttl_lru_cache(spark, sf_dir):
    """Lookups of each key and those a cache of one hour since the last lookup answers."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    gap = (F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(F.lag(c("ts").cast("timestamp")).over(w))) / 1e6
    return table(spark, sf_dir, "events").select("user_id", "event_type", gap.alias("gap")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("lookups"), F.count_if(c("gap") <= 3600).alias("hits"))
