"""Further queries of the engine's own operators: scores, entities, exports, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.operators import hypotheses as H
from factloom.operators import links as L
from factloom.operators import queries as Q
from factloom.operators import topics as P
from factloom.plans import export
from factloom.plans.reference_queries import terms_sql, CANON, ORACLES, QUERIES, _CLUSTERS, _htext, _HTEXT, host_sql, members, query, quoted, scalar, values_sql
from factloom.session import big_rank, table

c = F.col

# --- channel scores over weights drawn from the links -----------------------------------------------
_W = """w as (select dimension, channel, dense_rank() over (order by channel) as channel_ord, affinity, base from
 (select h.dimension, l.channel, round(avg(l.fit_score), 6) as affinity from links l join hypotheses h using (hypothesis_id) where h.dimension is not null and l.channel is not null group by 1, 2)
 join (select channel, round(avg(confidence) * 100, 6) as base from links where channel is not null group by 1) using (channel)),
sc as (select hypothesis_id, channel, channel_ord, round_even(coalesce(affinity, 0) * 0.6 + coalesce(base, 0) * 0.4, 0)::int as score from hypotheses join w using (dimension))"""


def weights(spark, sf_dir):
    """(dimension, channel, channel_ord, affinity, base): mean fit and confidence of the links seen so far."""
    links = table(spark, sf_dir, "links").where("channel is not null").select("hypothesis_id", "channel", "fit_score", "confidence")
    dims = table(spark, sf_dir, "hypotheses").where("dimension is not null").select("hypothesis_id", "dimension")
    affinity = links.join(dims, "hypothesis_id").groupBy("dimension", "channel").agg(F.round(F.avg("fit_score"), 6).alias("affinity"))
    base = links.groupBy("channel").agg(F.round(F.avg("confidence") * 100, 6).alias("base"))
    # channels are a small fixed set, so their order fits one task
    ords = base.select("channel", F.dense_rank().over(Window.orderBy("channel")).alias("channel_ord"))
    return affinity.join(base, "channel").join(ords, "channel")


@query(f"with {_W} select hypothesis_id, channel, score from sc")
def all_channel_scores(spark, sf_dir):
    hyp = table(spark, sf_dir, "hypotheses")
    return H.score_channels(hyp, weights(spark, sf_dir), threshold=-1, top=10**6).select("hypothesis_id", "channel", "score")


@query(f"with {_W}, o as (select *, row_number() over (partition by hypothesis_id order by score desc, channel_ord) as place from sc where score >= 50) select hypothesis_id, channel, score, place from o where place <= 5")
def score_channels(spark, sf_dir):
    return H.score_channels(table(spark, sf_dir, "hypotheses"), weights(spark, sf_dir)).withColumn("place", c("place").cast("bigint"))


@query(f"with {_W} select hypothesis_id, count(*) as n_fit from sc where score >= 50 group by 1")
def fit_threshold(spark, sf_dir):
    return H.score_channels(table(spark, sf_dir, "hypotheses"), weights(spark, sf_dir), top=10**6).groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("n_fit"))


@query(f"with {_W}, f as (select distinct h.force_assignment, l.channel from links l join hypotheses h using (hypothesis_id) where l.verdict = 'refutes' and l.confidence > 0.9) select s.hypothesis_id, s.channel from sc s join hypotheses h using (hypothesis_id) where score >= 50 and not exists (select 1 from f where f.force_assignment = h.force_assignment and f.channel = s.channel)")
def anti_platform_exclude(spark, sf_dir):
    hyp = table(spark, sf_dir, "hypotheses")
    bad = table(spark, sf_dir, "links").where("verdict = 'refutes' and confidence > 0.9").join(hyp.select("hypothesis_id", "force_assignment"), "hypothesis_id").select("force_assignment", "channel").distinct()
    return H.score_channels(hyp, weights(spark, sf_dir), bad, top=10**6).select("hypothesis_id", "channel")


# --- entities and topics ------------------------------------------------------------------------------
_CAP = P.CAPITALISED.replace("'", "''")
_FOUND = rf"""ef as (select hypothesis_id, list_filter(list_transform(regexp_extract_all(statement, '\b{_CAP}', 1), lambda s: case when lower(split_part(s, ' ', 1)) in ({quoted(P.HEAD_WORDS)}) then regexp_replace(s, '^\S+\s*', '') else s end),
 lambda s: length(s) >= 3 and lower(s) not in ({quoted(P.HEAD_WORDS)}) and lower(s) not in ({quoted(H.PLACES)}) and lower(split_part(s, ' ', 1)) not in ({quoted(P.ROLE_NOUNS)})) as l from hypotheses)"""


@query(f"with {_FOUND}, p as (select hypothesis_id, unnest(l) as entity, generate_subscripts(l, 1) as i from ef), f as (select hypothesis_id, min_by(entity, i) as entity, min(i) as i from p group by hypothesis_id, lower(entity)) select hypothesis_id, row_number() over (partition by hypothesis_id order by i) - 1 as pos, entity from f")
def extract_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "hypotheses").select("hypothesis_id", F.posexplode(P.entities(c("statement"))).alias("pos", "entity"))
    return rows.select("hypothesis_id", c("pos").cast("bigint"), "entity")


scalar("primary_entity", "hypotheses", "hypothesis_id", lambda: {"primary_entity": P.primary(P.entities(c("statement")))}, f"with {_FOUND} select hypothesis_id, l[1] as primary_entity from ef")
_TERMS = quoted(sorted(dict.fromkeys(P.TOPICS), key=lambda t: -len(t)))
scalar(
    "category_topics", "hypotheses", "hypothesis_id", lambda: {"topics": F.array_join(P.topics(_htext()), ",")},
    rf"with h as (select hypothesis_id, {_HTEXT} as t from hypotheses) select hypothesis_id, array_to_string(list_filter([{_TERMS}], lambda x: case when regexp_matches(x, '[ -]') then contains(t, x) else list_contains(regexp_split_to_array(t, '[^\p{{L}}\p{{N}}_]+'), x) end)[1:12], ',') as topics from h",
)


# --- lookups -------------------------------------------------------------------------------------------
#: A pool's host patterns with the number of results asked of each: parts of hosts, and suffixes that begin with a dot or a name.
PATTERNS = [("larkfield.example", "suffix", 5), ("grainpost1.example", "suffix", 3), ("oatwatch", "part", 20), ("forum.", "part", 20)]


@query(rf"""with h as (select link_id, hypothesis_id, {host_sql()} as host from links), p(pattern, kind, n) as ({values_sql(PATTERNS)})
select link_id, pattern from h join p on case kind when 'suffix' then host = pattern or ends_with(host, '.' || pattern) else contains(host, pattern) end""")
def host_matches(spark, sf_dir):
    return L.host_matches(table(spark, sf_dir, "links").select("link_id", U.host_of(c("url")).alias("host")), PATTERNS).select("link_id", "pattern")


@query("select count(*) as n_urls, count(b.url) as cached, count(*) - count(b.url) as missing from (select distinct url from links where url <> '') l left join (select distinct url from bodies where text <> '') b using (url)")
def scan_bodies(spark, sf_dir):
    urls = table(spark, sf_dir, "links").where("url <> ''").select("url").distinct()
    known = table(spark, sf_dir, "bodies").where("text <> ''").select("url").distinct().withColumn("hit", F.lit(1))
    return urls.join(known, "url", "left").agg(F.count(F.lit(1)).alias("n_urls"), F.count("hit").alias("cached"), (F.count(F.lit(1)) - F.count("hit")).alias("missing"))


@query(f"with {CANON}, k as (select canon, min_by(snippet, link_id) filter (verdict = 'supports' and snippet <> '') as quote from cl group by 1) select link_id, quote from cl join k using (canon)")
def quote_lookup(spark, sf_dir):
    keyed = table(spark, sf_dir, "links").select("link_id", F.md5(U.canonical_url(c("url"))).alias("k"), "snippet", "verdict")
    first = keyed.groupBy("k").agg(F.min_by("snippet", F.when((c("verdict") == "supports") & (c("snippet") != ""), c("link_id"))).alias("quote"))
    return keyed.select("link_id", "k").join(first, "k").select("link_id", "quote")


@query("""with p as (select distinct least(a.hypothesis_id, b.hypothesis_id) as id_a, greatest(a.hypothesis_id, b.hypothesis_id) as id_b from hypotheses a join hypotheses b on b.hypothesis_id = a.contrarian_pair_id where a.hypothesis_id <> b.hypothesis_id)
select id_a, id_b, channel, lower(trim(query_text)) as q, min(link_id) as link_id from p join links l on l.hypothesis_id = id_a or l.hypothesis_id = id_b where trim(query_text) <> '' group by 1, 2, 3, 4""")
def pair_pooled(spark, sf_dir):
    pairs = H.pairs(table(spark, sf_dir, "hypotheses"))
    sides = pairs.select("id_a", "id_b", F.explode(F.array("id_a", "id_b")).alias("hypothesis_id"))
    links = table(spark, sf_dir, "links").where("trim(query_text) <> ''").select("link_id", "hypothesis_id", "channel", F.lower(F.trim("query_text")).alias("q"))
    return sides.join(links, "hypothesis_id").groupBy("id_a", "id_b", "channel", "q").agg(F.min("link_id").alias("link_id"))


@query("""select link_id, (row_number() over (partition by hypothesis_id order by link_id) - 1) // 6 as batch, case when lower(verdict) in ('supports', 'refutes', 'tangential') then lower(verdict) else 'tangential' end as verdict, least(1.0, greatest(0.0, coalesce(confidence, 0.5))) as confidence from links""")
def llm_verdict_batch(spark, sf_dir):
    """Batches of six for a model, and the validation of its answers: known verdicts, confidence within 0 and 1 (missing as 0.5)."""
    v = F.lower("verdict")
    slim = table(spark, sf_dir, "links").select("link_id", "hypothesis_id", F.when(v.isin(*L.VERDICT_ORDER), v).otherwise("tangential").alias("verdict"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.5)))).alias("confidence"))
    return big_rank(slim, ["hypothesis_id"], [c("link_id")], "n").select("link_id", F.floor((c("n") - 1) / 6).alias("batch"), "verdict", "confidence")


@query(f"with {_CLUSTERS}, e as (select distinct x.sc, x.representative from cx x join links l on l.link_id = x.representative where l.is_short_video and l.duration_sec is null), o as (select *, row_number() over (partition by sc order by representative) as n from e) select sc as hypothesis_id, representative from o where n <= 30")
def enrichment_candidates(spark, sf_dir):
    bare = table(spark, sf_dir, "links").where("is_short_video and duration_sec is null").select(c("link_id").alias("representative"))
    heads = members(spark, sf_dir).select("hypothesis_id", "representative").distinct().join(bare, "representative")
    w = Window.partitionBy("hypothesis_id").orderBy("representative")
    return heads.withColumn("n", F.row_number().over(w)).where("n <= 30").select("hypothesis_id", "representative")


@query()
def results_json(spark, sf_dir):
    return export.results_json(table(spark, sf_dir, "links"), table(spark, sf_dir, "hypotheses"))


@query("select regexp_replace(hypothesis_id || ' ' || coalesce(dimension, ''), '[^A-Za-z0-9._\\-]', '_', 'g') as name, hypothesis_id from hypotheses")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "hypotheses").select(F.regexp_replace(F.concat("hypothesis_id", F.lit(" "), F.coalesce("dimension", F.lit(""))), r"[^A-Za-z0-9._\-]", "_").alias("name"), "hypothesis_id")


# --- query texts --------------------------------------------------------------------------------------
_WORDSPLIT = r"regexp_split_to_array(t, '[^\p{L}\p{N}_]+')"


def _lex(terms: list[str]) -> str:
    one, many = [t for t in terms if " " not in t and "-" not in t], [t for t in terms if " " in t or "-" in t]
    more = f"list_filter([{quoted(many)}], lambda x: contains(t, x))" if many else "[]::varchar[]"
    return f"list_sort(list_concat(list_filter([{quoted(one)}], lambda x: list_contains({_WORDSPLIT}, x)), {more}))"


_SLOTS = rf"""{_FOUND}, pe as (select hypothesis_id, unnest(l) as entity, generate_subscripts(l, 1) as i from ef), pf as (select hypothesis_id, min_by(entity, i) as entity, min(i) as i from pe group by hypothesis_id, lower(entity)),
pl as (select hypothesis_id, list(lower(entity) order by i) as e from pf group by 1), tx as (select hypothesis_id, {_HTEXT} as t from hypotheses),
sl as (select hypothesis_id, e[1] as b, e[2:6] as alts, {_lex(H.PAINS)} as pains, {_lex(H.ASPIRATIONS)} as asp,
 coalesce(list_filter([{_TERMS}], lambda x: case when regexp_matches(x, '[ -]') then contains(t, x) else list_contains({_WORDSPLIT}, x) end)[1], e[1]) as cat from pl join tx using (hypothesis_id)),
qa as (select hypothesis_id, list_concat(list_concat(list_concat(
 list_transform(case when len(pains) > 0 then list_transform(pains[1:3], lambda p: b || ' ' || p) else [b || ' review negative'] end, lambda x: struct_pack(a := 1, x := x)),
 list_transform(alts[1:3], lambda y: struct_pack(a := 2, x := 'why i switched from ' || b || ' to ' || y))),
 list_concat(list_transform(alts[1:3], lambda y: struct_pack(a := 3, x := b || ' vs ' || y || ' {Q.DIMENSION}')), list_transform(asp[1:2], lambda y: struct_pack(a := 4, x := 'best ' || cat || ' for ' || y)))),
 [struct_pack(a := 6, x := 'why i love ' || b), struct_pack(a := 6, x := b || ' is actually good'), {', '.join(f"struct_pack(a := 7, x := cat || ' {r}')" for r in Q.ROLES)}, {', '.join(f"struct_pack(a := 8, x := b || ' {y}')" for y in Q.YEARS)}, struct_pack(a := 8, x := b || ' controversy')]) as l from sl),
qb as (select hypothesis_id, unnest(l) as r, generate_subscripts(l, 1) as i from qa), qc as (select hypothesis_id, r.x as text, min(i) as i, min_by(r.a, i) as archetype from qb group by 1, 2),
qd as (select *, row_number() over (partition by hypothesis_id order by i) - 1 as pos from qc)"""


@query(f"with {_SLOTS} select hypothesis_id, pos, archetype, text from qd where pos < {Q.CAP}")
def synthesize_queries(spark, sf_dir):
    return Q.synthesize(table(spark, sf_dir, "hypotheses")).withColumn("pos", c("pos").cast("bigint"))


@query(f"with {_SLOTS} select archetype, count(*) as n from qd where pos < {Q.CAP} group by 1")
def gen_archetype(spark, sf_dir):
    return Q.synthesize(table(spark, sf_dir, "hypotheses")).groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_SLOTS} select hypothesis_id, b as brand, array_to_string(alts, ',') as alternatives, array_to_string(pains[1:3], ',') as pains, cat as category from sl where b is not null")
def assemble_slots(spark, sf_dir):
    return Q.slots(table(spark, sf_dir, "hypotheses")).where("brand is not null").select("hypothesis_id", "brand", F.array_join("alternatives", ",").alias("alternatives"), F.array_join(F.slice("pains", 1, 3), ",").alias("pains"), "category")


@query(rf"""with t as (select hypothesis_id, {terms_sql('expected_signals')} as l from hypotheses), d as (select hypothesis_id, list_filter(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda t: regexp_replace(t, '[^\p{{L}}\p{{N}}\-]', '', 'g')), lambda t: t <> '') as l from t)
select hypothesis_id, case when len(l) > 0 then '(?i)\b(' || array_to_string(l, '|') || ')(?:s|es|ed|ing|er|ers|ly)?\b' end as pattern from d""")
def compile_terms(spark, sf_dir):
    return table(spark, sf_dir, "hypotheses").select("hypothesis_id", T.term_pattern(T.signal_terms(T.list_cell(c("expected_signals")))).alias("pattern"))


scalar("api_duration_band", "links", "link_id", lambda: {"short_band": F.coalesce(c("duration_sec") <= 181, F.lit(True)), "long_band": F.coalesce(c("duration_sec") >= 182, F.lit(True))}, "select link_id, coalesce(duration_sec <= 181, true) as short_band, coalesce(duration_sec >= 182, true) as long_band from links")
#: Durations in every shape, beside the ids of links as texts that are none.
ISO = ("url", [(-1 - i, t) for i, t in enumerate(("PT1H2M3S", "PT4M", "PT59S", "PT2H", "PT0S", "PT", "P1DT2H", "pt3m", "PT3M ", "", None, "PT100M1S"))])
scalar(
    "parse_iso_duration", "links", "link_id", lambda: {"seconds": T.iso_seconds(c("url"))},
    r"with a as (select link_id, regexp_matches(url, '^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$') as ok, " + ", ".join(f"coalesce(try_cast(regexp_extract(url, '^PT(?:(\\d+)H)?(?:(\\d+)M)?(?:(\\d+)S)?$', {k}) as int), 0) as {n}" for k, n in ((1, "h"), (2, "m"), (3, "s"))) + " from links) select link_id, case when ok then nullif(h * 3600 + m * 60 + s, 0) end as seconds from a",
    ISO,
)
scalar(
    "query_urls", "links", "link_id", lambda: {"search_url": F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(F.regexp_replace("query_text", "[^A-Za-z0-9 ]", "")))},
    "select link_id, 'https://www.google.com/search?q=' || replace(url_encode(regexp_replace(query_text, '[^A-Za-z0-9 ]', '', 'g')), '%20', '+') as search_url from links",
)


@query("select l.hypothesis_id, h.dimension, count(*) as n_links from links l join hypotheses h using (hypothesis_id) where l.verdict = 'supports' group by 1, 2")
def member_links(spark, sf_dir):
    n = table(spark, sf_dir, "links").where("verdict = 'supports'").groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("n_links"))
    return n.join(table(spark, sf_dir, "hypotheses").select("hypothesis_id", "dimension"), "hypothesis_id").select("hypothesis_id", "dimension", "n_links")


__all__ = ["ORACLES", "QUERIES"]
