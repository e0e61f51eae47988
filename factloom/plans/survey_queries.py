"""Queries of exports, synthesis, manifests, decomposition, state and sources, each with the SQL that gives the same rows.

Where the tables lack the cases that an operator decides, rows that meet each of them are added to the whole table, in both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.operators import hypotheses as H
from factloom.operators import links as L
from factloom.operators import manifest as M
from factloom.operators import model, state
from factloom.operators import topics as P
from factloom.plans import export
from factloom.plans.more_queries import _FOUND
from factloom.plans.reference_queries import _RATES, _SIGNALS, _patterns, evidence, plus, plus_sql, query, quoted, strip_sql_blank, values_sql
from factloom.session import big_rank, salted_join, table

c = F.col
micros = lambda x: F.unix_micros(c(x).cast("timestamp"))

# --- the full row of an export ------------------------------------------------------------------------
_LINE = lambda x: f"replace(replace({x}, chr(13), ' '), chr(10), ' ')"
_LIST = lambda x: rf"coalesce(array_to_string(list_transform(list_filter({x}, lambda y: y <> ''), lambda y: regexp_replace({_LINE('y')}, '^\s+|\s+$', '', 'g')), ' | '), '')"
_NUM = lambda x: rf"case when {x} is null then '' else coalesce(nullif(regexp_replace(regexp_replace(format('{{:.6f}}', {x}), '0+$', ''), '\.$', ''), ''), '0') end"
_AT = lambda x: rf"coalesce(regexp_replace(strftime(make_timestamp(epoch_us({x})), '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '') || '+00:00', '')"
_SV = lambda x: f"case when l.is_short_video then coalesce({x}, '') else '' end"
_ROW = rf"""cv0 as (select link_id, any_value(hashtags) as hashtags, any_value(top_comments) as top_comments, any_value(transcript) as transcript from short_videos group by 1),
row as (select l.link_id, coalesce(l.hypothesis_id, '') as hypothesis_id, coalesce(verdict, '') as verdict, {_NUM('confidence')} as confidence, coalesce(channel, '') as channel, case when l.is_short_video then 'true' else 'false' end as is_short_video,
 coalesce(nullif(geo_scope, ''), 'unknown') as geo_scope, coalesce(url, '') as url, coalesce(nullif(canonical_url, ''), url, '') as canonical_url, {_LINE("coalesce(title, '')")} as title, {_LINE("coalesce(snippet, '')")} as snippet,
 {_SV('creator')} as creator, {_SV('duration_sec::varchar')} as duration_sec, {_SV('view_count::varchar')} as view_count, {_SV('like_count::varchar')} as like_count, {_SV('comment_count::varchar')} as comment_count, {_SV('share_count::varchar')} as share_count,
 {_SV(_NUM('engagement_score'))} as engagement_score, {_SV(_LIST('v.hashtags'))} as hashtags, {_SV(_LIST('v.top_comments'))} as top_comments, {_SV("regexp_replace(" + _LINE("substr(v.transcript, 1, 500)") + r", '^\s+|\s+$', '', 'g')")} as transcript_preview,
 {_LIST('signal_tags')} as signal_tags, {_LIST('also_found_on')} as also_found_on, coalesce(query_text, '') as query_text, coalesce(archetype::varchar, '') as archetype, coalesce(archetype_name, '') as archetype_name,
 case falsifier when true then 'true' when false then 'false' else '' end as falsifier, coalesce(target_signal, '') as target_signal, coalesce(backend_used, '') as backend_used, {_AT('discovered_at')} as discovered_at, {_AT('observed_at')} as observed_at
 from links l left join cv0 v using (link_id))"""


@query(f"with {_ROW} select * from row")
def link_csv_row(spark, sf_dir):
    return export.link_rows(table(spark, sf_dir, "links"), table(spark, sf_dir, "short_videos"))


@query(f"with {_ROW} select row.*, coalesce(h.core_problem_id, '') as core_problem_id, coalesce(core_problem_statement, '') as core_problem_statement, coalesce(statement, '') as statement from row left join hypotheses h on h.hypothesis_id = row.hypothesis_id")
def batch_raw_csv(spark, sf_dir):
    """The full rows with their hypothesis's problem and statement; one hypothesis may hold a tenth of them, so the join is salted."""
    rows = export.link_rows(table(spark, sf_dir, "links"), table(spark, sf_dir, "short_videos"))
    own = table(spark, sf_dir, "hypotheses").select("hypothesis_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("core_problem_id", "core_problem_statement", "statement")])
    return salted_join(rows, own, "hypothesis_id", c("link_id")).na.fill("", ["core_problem_id", "core_problem_statement", "statement"])


@query("""with v as (select link_id, max(creator_followers) as followers, any_value(caption) as caption, any_value(hashtags) as hashtags, any_value(top_comments) as top_comments, any_value(transcript) as transcript from short_videos group by 1)
select l.link_id, coalesce(nullif(caption, ''), snippet) as text, coalesce(followers, 0) as followers, array_to_string(list_transform(list_filter(hashtags, lambda x: x <> ''), lambda x: lower(x)), ',') as hashtags,
 array_to_string(top_comments[1:5], ' // ') as top_comments, coalesce(transcript, '') as transcript from links l left join v using (link_id)""")
def video_enrichment(spark, sf_dir):
    """Every link, with the details of its video over its own where they are given, and the first five comments."""
    videos = table(spark, sf_dir, "short_videos").groupBy("link_id").agg(F.max("creator_followers").alias("f"), *[F.first(x).alias(x) for x in ("caption", "hashtags", "top_comments", "transcript")])
    both = table(spark, sf_dir, "links").select("link_id", "snippet").join(videos, "link_id", "left")
    tags = F.array_join(F.transform(F.filter("hashtags", lambda x: x != ""), F.lower), ",")
    return both.select("link_id", F.coalesce(F.nullif("caption", F.lit("")), c("snippet")).alias("text"), F.coalesce("f", F.lit(0)).alias("followers"), tags.alias("hashtags"), F.array_join(F.slice("top_comments", 1, 5), " // ").alias("top_comments"), F.coalesce("transcript", F.lit("")).alias("transcript"))


@query(f"""with {_RATES}, m as (select l.link_id, list_concat(coalesce(l.signal_tags, []), list_transform(list_concat(coalesce(regexp_extract_all(ev.evidence, pat.sig, 1), []), coalesce(regexp_extract_all(ev.evidence, pat.ctr, 1), [])), lambda x: lower(x))) as t
 from links l join ev on ev.link_id = l.link_id left join pat on pat.hypothesis_id = l.hypothesis_id) select link_id, array_to_string(list_sort(list_distinct(t)), '|') as tags from m""")
def triage_tags(spark, sf_dir):
    """The tags that triage leaves on a link: its own, and the terms of either side met in its evidence, sorted."""
    links = table(spark, sf_dir, "links").select("link_id", "hypothesis_id", "signal_tags").join(evidence(spark, sf_dir), "link_id")
    met = salted_join(links, _patterns(spark, sf_dir), "hypothesis_id", c("link_id"))
    none = F.array().cast("array<string>")
    found = lambda p: F.coalesce(T.matched(c("evidence"), c(p)), none)
    tags = F.array_sort(F.array_distinct(F.concat(F.coalesce("signal_tags", none), found("sig"), found("ctr"))))
    return met.select("link_id", F.array_join(tags, "|").alias("tags"))


#: Texts with terms in other case, with endings, repeated and absent; the pattern of the terms is that of compile_terms.
HITS = [(1, "Price went up, prices fell, PRICE again", "price|label"), (2, "labels labelled labeling", "price|label"), (3, "nothing here", "price|label"), (4, "", "price"), (5, "the taste-test", "taste-test|x"), (6, None, "price")]


@query(rf"""with v(id, text, terms) as ({values_sql(HITS)}), m as (select id, list_transform(regexp_extract_all(text, '(?i)\b(' || terms || ')(?:s|es|ed|ing|er|ers|ly)?\b', 1), lambda x: lower(x)) as l from v)
select id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') as tags from m""")
def matched_terms(spark, sf_dir):
    """The terms met in a text, each once in lower case, in order of their first place."""
    df = spark.createDataFrame(HITS, "id int, text string, terms string")
    return df.select("id", F.coalesce(F.array_join(T.matched(c("text"), T.term_pattern(F.split("terms", r"\|"))), ","), F.lit("")).alias("tags"))


# --- synthesis ----------------------------------------------------------------------------------------
_QUOTES = f"""ax as (select hypothesis_id, signal, pos from (select *, row_number() over (partition by hypothesis_id, lower(signal) order by pos) as n from sig) where n = 1),
qs as (select link_id, hypothesis_id, verdict, lower({strip_sql_blank('target_signal')}) as val from links where verdict in ('supports', 'refutes') and snippet <> ''),
mt as (select q.link_id, q.hypothesis_id, verdict, min(pos) as pos from qs q join ax a on a.hypothesis_id = q.hypothesis_id and (contains(lower(signal), val) or contains(val, lower(signal))) where val <> '' group by 1, 2, 3),
cov as (select a.hypothesis_id, a.pos, a.signal as axis, count(*) filter (verdict = 'supports') as supports, count(*) filter (verdict = 'refutes') as refutes from ax a left join mt m on m.hypothesis_id = a.hypothesis_id and m.pos = a.pos group by 1, 2, 3)"""


def _coverage(spark, sf_dir):
    """(hypothesis_id, pos, axis, supports, refutes): quotes by side on each of a hypothesis's own signals, zeros kept. A quote counts for
    the first signal that holds its label or is held by it."""
    axes = table(spark, sf_dir, "hypotheses").select("hypothesis_id", M.once(T.list_cell(F.coalesce("expected_signals", F.lit("")))).alias("axes"))
    quotes = table(spark, sf_dir, "links").where(c("verdict").isin("supports", "refutes") & (c("snippet") != "")).select("link_id", "hypothesis_id", "verdict", F.lower(U.strip(c("target_signal"))).alias("val")).where("val <> ''")
    # the axes of a hypothesis travel as one short array, so a quote meets them in one row
    met = salted_join(quotes, axes, "hypothesis_id", c("link_id"), "inner")
    place = F.array_position(F.transform("axes", lambda a: F.lower(a).contains(c("val")) | c("val").contains(F.lower(a))), F.lit(True))
    counts = met.select("hypothesis_id", "verdict", (place - 1).alias("i")).where("i >= 0").groupBy("hypothesis_id", "i").agg(F.count_if(c("verdict") == "supports").alias("s"), F.count_if(c("verdict") == "refutes").alias("r"))
    each = axes.select("hypothesis_id", F.posexplode("axes").alias("i", "axis"))
    zero = [F.coalesce(c(a), F.lit(0)).alias(b) for a, b in (("s", "supports"), ("r", "refutes"))]
    return each.join(counts, ["hypothesis_id", "i"], "left").select("hypothesis_id", "i", "axis", *zero)


@query(f"with {_SIGNALS}, {_QUOTES} select hypothesis_id, axis, supports, refutes from cov")
def coverage(spark, sf_dir):
    return _coverage(spark, sf_dir).select("hypothesis_id", "axis", "supports", "refutes")


@query(f"with {_SIGNALS}, {_QUOTES} select link_id, signal as axis from mt join ax using (hypothesis_id, pos)")
def coverage_match(spark, sf_dir):
    """The axis that a quote's label counts for."""
    axes = table(spark, sf_dir, "hypotheses").select("hypothesis_id", M.once(T.list_cell(F.coalesce("expected_signals", F.lit("")))).alias("axes"))
    quotes = table(spark, sf_dir, "links").where(c("verdict").isin("supports", "refutes") & (c("snippet") != "")).select("link_id", "hypothesis_id", F.lower(U.strip(c("target_signal"))).alias("val")).where("val <> ''")
    met = salted_join(quotes, axes, "hypothesis_id", c("link_id"), "inner")
    first = F.filter("axes", lambda a: F.lower(a).contains(c("val")) | c("val").contains(F.lower(a)))
    return met.select("link_id", F.try_element_at(first, F.lit(1)).alias("axis")).where("axis is not null")


_GAPS = "gp as (select hypothesis_id, string_agg('cohort:' || axis, ',' order by pos) as gaps, string_agg('cohort:' || axis, ', ' order by pos) filter (place <= 4) as few from (select *, row_number() over (partition by hypothesis_id order by pos) as place from cov where supports + refutes < 1) group by 1)"


@query(f"with {_SIGNALS}, {_QUOTES}, {_GAPS} select hypothesis_id, gaps from gp")
def evidence_gaps(spark, sf_dir):
    """The axes of each hypothesis without any quote, in order."""
    return _gaps(spark, sf_dir).select("hypothesis_id", F.array_join("gaps", ",").alias("gaps"))


def _gaps(spark, sf_dir):
    open_axes = _coverage(spark, sf_dir).where("supports + refutes < 1")
    # at most one hypothesis's own signals
    return open_axes.groupBy("hypothesis_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "axis"))), lambda x: F.concat(F.lit("cohort:"), x["axis"])).alias("gaps"))


def headline(s: Column, r: Column) -> Column:
    """One line on the balance of supporting and refuting sources."""
    say = lambda f, *a: F.format_string(f, *a)
    return (
        F.when((s == 0) & (r == 0), "Inconclusive — no direct evidence found").when(r == 0, say("Supports — %d corroborating sources, 0 refutations", s)).when(s == 0, say("Refutes — %d disconfirming sources, 0 corroborations", r))
        .when(s >= 3 * r, say("Largely supports — %d corroborating vs %d refuting", s, r)).when(r >= 3 * s, say("Largely refutes — %d disconfirming vs %d corroborating", r, s)).otherwise(say("Mixed evidence — %d supports / %d refutes", s, r))
    )


_HEADLINE = """case when s = 0 and r = 0 then 'Inconclusive — no direct evidence found' when r = 0 then format('Supports — {} corroborating sources, 0 refutations', s) when s = 0 then format('Refutes — {} disconfirming sources, 0 corroborations', r)
 when s >= 3 * r then format('Largely supports — {} corroborating vs {} refuting', s, r) when r >= 3 * s then format('Largely refutes — {} disconfirming vs {} corroborating', r, s) else format('Mixed evidence — {} supports / {} refutes', s, r) end"""


@query(f"with n as (select hypothesis_id, count(*) filter (verdict = 'supports') as s, count(*) filter (verdict = 'refutes') as r from links group by 1) select hypothesis_id, s as supports, r as refutes, {_HEADLINE} as headline from n")
def verdict_summary(spark, sf_dir):
    n = table(spark, sf_dir, "links").groupBy("hypothesis_id").agg(F.count_if(c("verdict") == "supports").alias("supports"), F.count_if(c("verdict") == "refutes").alias("refutes"))
    return n.select("hypothesis_id", "supports", "refutes", headline(c("supports"), c("refutes")).alias("headline"))


@query(f"""with {_SIGNALS}, {_QUOTES}, {_GAPS}, q as (select *, coalesce(confidence, 0) as conf from links where snippet <> ''),
n as (select hypothesis_id, count(*) filter (verdict = 'supports') as s, count(*) filter (verdict = 'refutes') as r, count(*) filter (verdict is null or verdict not in ('supports', 'refutes')) as t,
 max_by(struct_pack(q := snippet, u := coalesce(url, '')), (conf, -link_id)) filter (verdict = 'supports') as bs, max_by(struct_pack(q := snippet, u := coalesce(url, '')), (conf, -link_id)) filter (verdict = 'refutes') as br from q group by 1)
select n.hypothesis_id, s as supports_count, r as refutes_count, t as tangential_count, concat_ws(' ', {_HEADLINE} || '.', 'Strongest support: "' || substr(bs.q, 1, 220) || '" (source: ' || substr(bs.u, 1, 80) || ').',
 'Strongest refutation: "' || substr(br.q, 1, 220) || '" (source: ' || substr(br.u, 1, 80) || ').', 'Coverage gaps: ' || few || '.') as paragraph from n left join gp on gp.hypothesis_id = n.hypothesis_id""")
def synthesis_row(spark, sf_dir):
    """Counts by side and a paragraph: the headline, the most relevant quote of each side (ties: the smaller id), the first four gaps."""
    quotes = table(spark, sf_dir, "links").where("snippet <> ''")

    def best(v: str) -> Column:
        return F.max_by(F.struct("snippet", F.coalesce("url", F.lit("")).alias("url")), F.when(c("verdict") == v, F.struct(F.coalesce("confidence", F.lit(0.0)), (-c("link_id")).alias("n"))))

    n = quotes.groupBy("hypothesis_id").agg(
        F.count_if(c("verdict") == "supports").alias("s"), F.count_if(c("verdict") == "refutes").alias("r"), F.count_if(~F.coalesce(c("verdict").isin("supports", "refutes"), F.lit(False))).alias("t"),
        best("supports").alias("bs"), best("refutes").alias("br"),
    ).join(_gaps(spark, sf_dir), "hypothesis_id", "left")
    cite = lambda label, b, k: F.when(c(k) > 0, F.concat(F.lit(f'{label}: "'), F.substring(c(b)["snippet"], 1, 220), F.lit('" (source: '), F.substring(c(b)["url"], 1, 80), F.lit(").")))
    gaps = F.concat(F.lit("Coverage gaps: "), F.array_join(F.slice("gaps", 1, 4), ", "), F.lit("."))
    whole = F.concat_ws(" ", F.concat(headline(c("s"), c("r")), F.lit(".")), cite("Strongest support", "bs", "s"), cite("Strongest refutation", "br", "r"), gaps)
    return n.select("hypothesis_id", c("s").alias("supports_count"), c("r").alias("refutes_count"), c("t").alias("tangential_count"), whole.alias("paragraph"))


# --- answers of a model ---------------------------------------------------------------------------------
ANSWERS = [(1, '{"verdicts": [{"id": 1, "verdict": "supports", "confidence": 0.9, "signal_tags": [" Price ", ""]}, {"id": "2", "verdict": "refutes", "confidence": 7}, {"id": "x", "verdict": "supports"}, {"id": 3, "verdict": "maybe"}]}'), (2, '{"verdicts": [{"id": 4, "verdict": "tangential", "confidence": "high"}, {"id": 4, "verdict": "refutes", "confidence": -1}, {"id": 5, "verdict": "supports"}]}'), (3, "no json"), (4, None), (5, '{"verdicts": []}')]
QUOTES = [(1, '{"quote": " It fell. ", "stance": "SUPPORTS ", "relevance_score": 0.7, "cohort_evidenced": "young buyers"}'), (2, '{"quote": "x", "stance": "odd", "relevance_score": 9}'), (3, '{"stance": "refutes", "relevance_score": "bad", "extractor_note": "' + "n" * 300 + '"}'), (4, "none"), (5, None)]


@query(f"""with v(batch, answer) as ({values_sql(ANSWERS)}), j as (select batch, unnest(json_extract(answer, '$.verdicts[*]')) as v, generate_subscripts(json_extract(answer, '$.verdicts[*]'), 1) as pos from v where json_valid(answer)),
r as (select batch, pos, try_cast(v->>'$.id' as int) as id, v->>'$.verdict' as verdict, greatest(0.0, least(1.0, case when v->>'$.confidence' is null then 0.5 else coalesce(try_cast(v->>'$.confidence' as double), 0.5) end)) as confidence,
 coalesce(array_to_string(list_filter(list_transform(v->>'$.signal_tags[*]', lambda x: lower(trim(x))), lambda x: x <> ''), ','), '') as tags from j)
select batch, id, arg_max(verdict, pos) as verdict, arg_max(confidence, pos) as confidence, arg_max(tags, pos) as tags from r where id is not null and verdict in ('supports', 'refutes', 'tangential') group by 1, 2""")
def llm_answers(spark, sf_dir):
    """What is usable of a model's answers to batches."""
    return model.verdict_rows(spark.createDataFrame(ANSWERS, "batch int, answer string")).select("batch", "id", "verdict", "confidence", F.array_join("signal_tags", ",").alias("tags"))


@query(f"""with v(id, answer) as ({values_sql(QUOTES)}) select id, trim(coalesce(answer->>'$.quote', '')) as quote, case when lower(trim(answer->>'$.stance')) in ('supports', 'refutes') then lower(trim(answer->>'$.stance')) else 'neutral' end as stance,
 greatest(0.0, least(1.0, coalesce(try_cast(answer->>'$.relevance_score' as double), 0.0))) as relevance_score, substr(trim(coalesce(answer->>'$.cohort_evidenced', '')), 1, 80) as cohort_evidenced, length(substr(trim(coalesce(answer->>'$.extractor_note', '')), 1, 200)) as note_length from v where starts_with(answer, '{{')""")
def extract_quote(spark, sf_dir):
    """What is usable of a model's quotes."""
    q = spark.createDataFrame(QUOTES, "id int, answer string").select("id", model.quote(c("answer")).alias("q")).where("q is not null")
    return q.select("id", "q.quote", "q.stance", "q.relevance_score", "q.cohort_evidenced", F.length("q.extractor_note").cast("bigint").alias("note_length"))


# --- manifests ------------------------------------------------------------------------------------------
MANIFEST = ("statement", [("~" + str(i), t) for i, t in enumerate((
    "Key competitors are Prestige, Sobha, Prestige and Lodha in the market.", "They compete with Godrej & DLF; rivals include Acme", "Rivals are customers, ab, lowercase and Zed Homes this year.", "Homes from INR 45 lakh or Rs. 1.2 crore, approved by RERA and SEBI",
    "A FDA note. Paid USD 30 and EUR 5 and usd 30 in Mumbai", "Aimed at salaried couples aged 35-50 and for the women aged 22 to 30, HNI and Gen Z", "ages 18-25 only", "After a wedding or a first job, some relocate; a baby is near", "The brand is perceived as warm, the modern and trusted & of value.", "It stands for x", None,
))])
_MTEXT = f"m as (select hypothesis_id, statement as t from {plus_sql('hypotheses', 'hypothesis_id', *MANIFEST)})"
_ONCE = lambda x: f"list_filter({x}, lambda x, i: list_position(list_transform({x}, lambda y: lower(y)), lower(x)) = i)"
_TAIL = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in M.PHRASES) + ")"
_PART = r"regexp_replace(regexp_replace(x, '^[\s.;:]+|[\s.;:]+$', '', 'g'), '^(?:and|or)\s+', '', 'i')"


def _mined(name: str, fn, sql: str, joined: str) -> None:
    def run(spark, sf_dir):
        return plus(spark, sf_dir, "hypotheses", "hypothesis_id", *MANIFEST).select("hypothesis_id", F.coalesce(F.array_join(fn(c("statement")), "|"), F.lit("")).alias("found"))

    query(f"with {_MTEXT}, {sql} select hypothesis_id, coalesce(array_to_string({joined}, '|'), '') as found from l", name)(run)


_mined("manifest_competitors", M.competitors, rf"""b as (select hypothesis_id, regexp_extract({_TAIL}, '(?s)^(.*?)(?:\b(?:in|on|this|that|over|since|across)\b|$)', 1) as b from m),
l as (select hypothesis_id, list_filter(list_transform(regexp_split_to_array(b, '\s*,\s*|\s*\band\b\s*|\s*&\s*'), lambda x: {_PART}), lambda x: length(x) >= 3 and regexp_matches(x, '^\p{{Lu}}') and lower(x) not in ({quoted(M.STOPS)})) as l from b)""", _ONCE("l"))  # fmt: skip
_mined("manifest_prices", M.prices, f"l as (select hypothesis_id, list_transform(regexp_extract_all(t, '({M.PRICE})', 1), lambda x: trim(x)) as l from m)", f"({_ONCE('l')})[1:8]")
_mined("manifest_regulators", M.regulators, rf"l as (select hypothesis_id, regexp_extract_all(t, '\b({'|'.join(M.REGULATORS)})\b', 1) as l from m)", "list_filter(l, lambda x, i: list_position(l, x) = i)")
_mined("manifest_triggers", M.triggers, f"l as (select hypothesis_id, list_filter([{quoted(sorted(M.TRIGGERS, key=lambda t: -len(t)))}], lambda x: contains(lower(t), x)) as l from m)", "l")
_mined("manifest_cohorts", M.cohorts, rf"""a as (select hypothesis_id, t, list_transform(regexp_extract_all(t, '({M.AGES})', 1), lambda m: concat_ws(' ', nullif(array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(m, '{M.AGE_TAIL}', ''), '^(?:(?:{'|'.join(M.FILLERS)})\s+)+', '', 'i')), '\s+'), lambda w: regexp_matches(w, '^\p{{L}}')), ' '), ''),
 'aged ' || regexp_extract(m, '{M.AGE_TAIL}', 1) || '-' || regexp_extract(m, '{M.AGE_TAIL}', 2))) as r from m), l as (select hypothesis_id, list_concat(r, list_filter([{quoted(M.SEGMENTS)}], lambda x: contains(lower(t), lower(x)))) as l from a)""", _ONCE("l"))  # fmt: skip
_mined("manifest_attributes", M.attributes, rf"""l as (select hypothesis_id, list_filter(list_transform(regexp_split_to_array(nullif(regexp_extract(t, '{M.STANDS_FOR}', 1), ''), '\s*,\s*|\s+and\s+|\s*&\s*'), lambda x: regexp_replace(lower(regexp_replace(x, '^[\s.;:]+|[\s.;:]+$', '', 'g')), '^(?:and|or|the|a|an|of|in)\s+', '')), lambda x: length(x) >= 3) as l from m)""", "(list_filter(l, lambda x, i: list_position(l, x) = i))[1:6]")
_WHEN = lambda t, x: "case " + " ".join(f"when {x} = '{k}' then '{v}'" for k, v in t.items() if v) + " end"
_mined("manifest_geo", M.geo_hints, rf"""g as (select hypothesis_id, list_filter([{quoted(M.CITIES)}], lambda x: contains(lower(t), x)) as cities, list_transform(regexp_extract_all(t, '(?i)\b(INR|Rs|₹|\$|USD|GBP|£|EUR|€)\.?\s*[\d.,]+', 1), lambda x: {_WHEN(M.CURRENCIES, 'upper(x)')}) as money,
 list_transform(regexp_extract_all(t, '\b({'|'.join(M.REGULATORS)})\b', 1), lambda x: {_WHEN(M.REGULATORS, 'x')}) as law from m), l as (select hypothesis_id, list_filter(list_concat(list_concat(money, law), list_concat(cities, case when len(cities) > 0 then ['india'] else [] end)), lambda x: x is not null) as l from g)""", "list_filter(l, lambda x, i: list_position(l, x) = i)")  # fmt: skip


@query("""select coalesce(nullif(trim(core_problem_id), ''), '_uncategorized') as core_problem_id, count(*) as n, min_by(nullif(trim(core_problem_statement), ''), hypothesis_id) filter (nullif(trim(core_problem_statement), '') is not null) as statement,
 string_agg(hypothesis_id, ',' order by hypothesis_id) as hypothesis_ids, count(*) filter (coalesce(trim(statement), '') = '') as without_statement from hypotheses group by 1""")
def batch_preview(spark, sf_dir):
    """Core problems with their hypotheses, first statement, and how many hypotheses lack one. The ids of a problem are its row's result."""
    return H.preview(table(spark, sf_dir, "hypotheses"))


@query(f"""with {_MTEXT} select count(*) as hypotheses, count(distinct h.core_problem_id) as core_problems, count(*) filter (coalesce(trim(t), '') = '') as missing_statements, (count(*) - count(distinct m.hypothesis_id)) as duplicate_ids,
 (select count(distinct upper(x)) from (select unnest(regexp_extract_all(t, '\\b({'|'.join(M.REGULATORS)})\\b', 1)) as x from m)) as regulators from m left join hypotheses h using (hypothesis_id)""")
def manifest_preview(spark, sf_dir):
    """One row on a whole manifest: what it holds and what its readers are warned of."""
    texts = plus(spark, sf_dir, "hypotheses", "hypothesis_id", *MANIFEST)
    own = texts.join(table(spark, sf_dir, "hypotheses").select("hypothesis_id", "core_problem_id"), "hypothesis_id", "left")
    ids = own.groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("statement"), F.lit("")) == "").alias("bare"))
    whole = ids.agg(F.sum("n").alias("hypotheses"), F.sum("bare").alias("missing_statements"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_ids"))
    problems = own.agg(F.countDistinct("core_problem_id").alias("core_problems"))
    laws = texts.select(F.explode(M.regulators(c("statement"))).alias("x")).agg(F.countDistinct("x").alias("regulators"))
    return whole.crossJoin(problems).crossJoin(laws)  # three tables of one row


# --- decomposition --------------------------------------------------------------------------------------
ENTITIES = [("~1", ["Kellogg", "Kellogg's Corn Flakes", "Corn Flakes", "Self-care", "Identity-driven"]), ("~2", ["Prospects in Bengaluru", "Mumbai", "Indian", "No", "AB", "Fresh"]), ("~3", ["Acme", "ACME Labs", "Popcorn", "Corn", "corn"]), ("~4", [])]
_FIRST = "e0 as (select hypothesis_id, list(entity order by i) as l from (select hypothesis_id, min_by(entity, i) as entity, min(i) as i from (select hypothesis_id, unnest(l) as entity, generate_subscripts(l, 1) as i from ef) group by hypothesis_id, lower(entity)) group by 1)"
_ROOT = lambda x: f"trim(regexp_replace(lower({x}), '[''’]s?$', ''))"
_NORM = lambda x: rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_NAMED = rf"""e1 as (select hypothesis_id, list_filter(l, lambda e: lower(e) not in ({quoted(M.BLOCKED)}) and (length(e) >= 3 or contains(e, ' ')) and not (contains(e, '-') and (len(list_filter(string_split(lower(e), '-'), lambda p: p in ({quoted(M.BLOCKED)}))) > 0
 or (len(string_split(e, '-')) = 2 and lower(string_split(e, '-')[2]) in ({quoted(M.SUFFIXES)})))) and lower(split_part(e, ' ', 1)) not in ({quoted(M.STOPS)})) as l from ea),
e2 as (select hypothesis_id, list_filter(l, lambda e: len(list_filter(l, lambda o: o <> e and {_ROOT("split_part(o, ' ', 1)")} = {_ROOT('e')} and length(o) > length(e))) = 0) as l from e1),
e3 as (select hypothesis_id, l, list_transform(l, lambda e: {_NORM('e')}) as n from e2),
e4 as (select hypothesis_id, list_filter(l, lambda e, i: n[i] = '' or len(list_filter(n, lambda o, j: i <> j and o <> '' and ((length(o) > length(n[i]) and contains(' ' || o || ' ', ' ' || n[i] || ' ')) or (o = n[i] and j < i)))) = 0) as l from e3)"""


@query(f"with {_FOUND}, {_FIRST}, ea as (select hypothesis_id, l from e0 union all " + " union all ".join(f"select '{k}', [{quoted(v)}]::varchar[]" for k, v in ENTITIES) + f"), {_NAMED} select hypothesis_id, array_to_string(l, '|') as entities from e4")
def post_filter_entities(spark, sf_dir):
    """Entities without lexicon words, shorter possessives and parts of longer names."""
    found = table(spark, sf_dir, "hypotheses").select("hypothesis_id", P.entities(c("statement")).alias("l")).where(F.size("l") > 0)
    whole = found.unionByName(spark.createDataFrame(ENTITIES, "hypothesis_id string, l array<string>"))
    return whole.select("hypothesis_id", F.array_join(M.named_entities(c("l")), "|").alias("entities"))


#: A manifest's context: brand, competitors, places, cohorts and further topics.
CONTEXT = {"brand": "Oatherly", "competitors": ["Kestoro", "Wexonia"], "geo": ["india", "mumbai"], "cohorts": ["salaried aged 35-50"], "topics": ["wedding", "premium"]}
_ARR = lambda x: f"[{quoted(x)}]"
_UNI = lambda a, b: f"list_concat({a}, list_filter({b}, lambda x: not list_contains({a}, x)))"


@query(f"""with {_FOUND}, {_FIRST}, ea as (select h.hypothesis_id, coalesce(l, []) as l from hypotheses h left join e0 using (hypothesis_id)), {_NAMED},
d as (select hypothesis_id, coalesce('{CONTEXT['brand']}', l[1]) as brand, list_filter(l[2:], lambda x: lower(x) <> lower('{CONTEXT['brand']}')) as rest from e4)
select hypothesis_id, brand as primary_entity, array_to_string(({_UNI(_ARR(CONTEXT['competitors']), 'rest')})[1:8], '|') as competitors from d""")
def decompose(spark, sf_dir):
    """Each hypothesis's brand and competitors, its own merged into those of the manifest's context."""
    return H.decompose(table(spark, sf_dir, "hypotheses"), CONTEXT).select("hypothesis_id", "primary_entity", F.array_join("competitors", "|").alias("competitors"))


# --- state ----------------------------------------------------------------------------------------------
#: Kinds of event as reports of sources, with the base of their cooldown in seconds.
_STATUS = {"view": ("ok", None), "click": ("captcha_cooldown", 600), "signup": ("missing_key", None), "purchase": ("rate_limited", 60), "error": ("unavailable", None)}
_NOW = 1_800_000_000_000_000


def reports(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for k, (s, _) in _STATUS.items() for x in (k, s)])
    base = F.create_map(*[F.lit(x) for k, (_, b) in _STATUS.items() for x in (k, b or 0)])
    return table(spark, sf_dir, "events").select(c("user_id").alias("source"), c("ts").alias("at"), c("event_id").alias("seq"), kind[c("event_type")].alias("status"), base[c("event_type")].alias("base_seconds"))


_REPORTS = f"""rp as (select user_id as source, ts, event_id, case event_type {' '.join(f"when '{k}' then '{s}'" for k, (s, _) in _STATUS.items())} end as status, case event_type {' '.join(f"when '{k}' then {b or 0}" for k, (_, b) in _STATUS.items())} end as base from events),
r1 as (select *, status in ({quoted(list(state.FAILURES))}) as bad, sum((status = 'ok')::int) over (partition by source order by ts, event_id rows unbounded preceding) as run, sum((status = 'ok')::int) over (partition by source) as oks from rp),
r2 as (select *, sum(bad::int) over (partition by source, run order by ts, event_id rows unbounded preceding) as streak from r1),
st as (select source, max_by(status, (ts, event_id)) as status, count(*) filter (bad and run = oks) as failures, count(*) filter (status = 'ok') as successes, count(*) filter (bad) as failed,
 max_by(least(3600, base * power(2, streak - 1)), (ts, event_id)) filter (bad and run = oks and base > 0)::bigint as cooldown, max_by(epoch_us(ts), (ts, event_id)) filter (bad and run = oks and base > 0) as set_at from r2 group by 1),
bl as (select *, set_at + cooldown * 1000000 as until, status in ({quoted(list(state.HARD))}) or (status in ({quoted(list(state.SOFT))}) and coalesce(set_at + cooldown * 1000000 > {_NOW}, false)) as blocked from st)"""


@query(f"with {_REPORTS} select source, status, failures, successes, failed, cooldown, until from bl")
def health_state(spark, sf_dir):
    """Status, failures in a row and cooldown of each source after its last report."""
    return state.source_states(reports(spark, sf_dir))


@query(f"with {_REPORTS} select source, blocked from bl")
def is_blocked(spark, sf_dir):
    return state.source_states(reports(spark, sf_dir)).select("source", state.blocked(F.lit(_NOW)).alias("blocked"))


@query(f"with {_REPORTS} select source, until from bl where status in ({quoted(list(state.SOFT))}) and until <= {_NOW}")
def recovery_probe(spark, sf_dir):
    """Sources whose cooldown is over and that are to be tried again."""
    return state.source_states(reports(spark, sf_dir)).where(c("status").isin(*state.SOFT) & (c("until") <= _NOW)).select("source", "until")


@query(f"with {_REPORTS} select bool_or(status = 'ok') as any_healthy, bool_or(status in ('quota_exhausted', 'captcha_cooldown', 'rate_limited', 'missing_key', 'not_installed')) as any_blocked, count(*) as sources, count(*) filter (blocked) as blocked_now from bl")
def health_snapshot(spark, sf_dir):
    s = state.source_states(reports(spark, sf_dir)).withColumn("blocked", state.blocked(F.lit(_NOW)))
    return s.agg(F.bool_or(c("status") == "ok").alias("any_healthy"), F.bool_or(c("status").isin("quota_exhausted", "captcha_cooldown", "rate_limited", "missing_key", "not_installed")).alias("any_blocked"), F.count(F.lit(1)).alias("sources"), F.count_if("blocked").alias("blocked_now"))


_KIND = {"view": "start", "purchase": "done", "error": "error"}


@query(f"""with e as (select user_id as job, ts, event_id, case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in _KIND.items())} else 'log' end as kind from events),
j as (select job, min_by(kind, (ts, event_id)) filter (kind in ('done', 'error')) as ended, min(ts) filter (kind in ('done', 'error')) as ended_at, bool_or(kind = 'start') as started, min(ts) as created, count(*) as n_events from e group by 1)
select job, coalesce(ended, case when started then 'running' else 'pending' end) as status, epoch_us(created) as created, epoch_us(ended_at) as finished, n_events from j""")
def job_state_machine(spark, sf_dir):
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv])[c("event_type")], F.lit("log"))
    return state.job_states(table(spark, sf_dir, "events").select(c("user_id").alias("job"), c("ts").alias("at"), c("event_id").alias("seq"), kind.alias("kind")))


_MEMBER = "mb as (select o_custkey as batch, o_orderkey as job, case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'error' end as status, o_totalprice, o_orderdate from orders)"


def _members(spark, sf_dir):
    """Orders as members of batches: a table of jobs with a status."""
    s = F.when(c("o_orderstatus") == "F", "done").when(c("o_orderstatus") == "O", "running").otherwise("error")
    return table(spark, sf_dir, "orders").select(c("o_custkey").alias("batch"), c("o_orderkey").alias("job"), s.alias("status"), "o_orderdate")


@query(f"with {_MEMBER} select batch, count(*) as members, count(*) filter (status = 'done') as done, count(*) filter (status = 'error') as error, count(*) filter (status = 'running') as running, case when count(*) filter (status = 'error') = 0 then 'done' when count(*) filter (status = 'done') = 0 then 'error' else 'partial' end as status from mb group by 1")
def batch_status(spark, sf_dir):
    return state.batch_states(_members(spark, sf_dir)).select("batch", "members", "done", "error", "running", "status")


@query(f"with {_MEMBER} select job, case when status = 'running' then 'skipped' else status end as after_cancel, case when status = 'running' then 'error' else status end as after_restore from mb")
def cancel(spark, sf_dir):
    """Status of each member after a cancel, and after a snapshot is read back."""
    return _members(spark, sf_dir).select("job", state.cancelled(c("status")).alias("after_cancel"), state.restored(c("status")).alias("after_restore"))


@query(f"with {_MEMBER}, b as (select batch, case when bool_or(status = 'running') then 'running' else 'done' end as status from mb group by 1) select batch, case when status = 'running' then 'partial' else status end as status from b")
def load_snapshots(spark, sf_dir):
    """Batches as a new session finds them: what was running is partial."""
    b = _members(spark, sf_dir).groupBy("batch").agg(F.when(F.bool_or(c("status") == "running"), "running").otherwise("done").alias("status"))
    return b.select("batch", state.restored(c("status"), True).alias("status"))


@query(f"with {_MEMBER} select job, status from mb order by o_orderdate desc, job limit 50")
def list_job_summaries(spark, sf_dir):
    """A report of the fifty newest jobs."""
    return _members(spark, sf_dir).orderBy(F.desc("o_orderdate"), "job").limit(50).select("job", "status")


@query("""with e as (select c_nationkey as batch, event_id, ts, user_id, event_type from events join customer on c_custkey = user_id) select batch, user_id as member, event_id, row_number() over (partition by batch order by ts, event_id) as seq from e""")
def batch_event_merge(spark, sf_dir):
    """The events of a batch's members in one numbered log, however many they are."""
    members = table(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id"), c("c_nationkey").alias("batch"))
    tagged = table(spark, sf_dir, "events").select("event_id", "ts", "user_id").join(members, "user_id")
    return big_rank(tagged, ["batch"], [c("ts"), c("event_id")], "seq").select("batch", c("user_id").alias("member"), "event_id", "seq")


@query("""with l as (select user_id, event_type, ts, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id, event_type order by ts, event_id)) as gap from events) select count(*) as lookups, count(*) filter (gap <= 3600000000) as hits, count(distinct (user_id, event_type)) as keys, round_even(count(*) filter (gap <= 3600000000) / count(*), 4) as hit_rate from l""")
def cache_stats(spark, sf_dir):
    """Totals of the cache of one hour since the last lookup."""
    from factloom.plans.reference_queries import QUERIES

    per = QUERIES["ttl_lru_cache"](spark, sf_dir)
    return per.agg(F.sum("lookups").alias("lookups"), F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("keys"), F.bround(F.sum("hits") / F.sum("lookups"), 4).alias("hit_rate"))


@query("""with b as (select coalesce(hypothesis_id, '') as hypothesis_id, coalesce(channel, '') as channel, count(*) as n, count(*) filter (observed_at is null) as undated from links group by 1, 2), c as (select distinct coalesce(channel, '') as channel from links), h as (select distinct hypothesis_id from hypotheses)
select h.hypothesis_id, c.channel, coalesce(n, 0) as n, case when n > 0 then 'ok' else 'no_results' end as state from h, c left join b on b.hypothesis_id = h.hypothesis_id and b.channel = c.channel""")
def channel_health(spark, sf_dir):
    """Every hypothesis and channel with the number of its links: ok, or no results."""
    links = table(spark, sf_dir, "links").select("hypothesis_id", F.coalesce("channel", F.lit("")).alias("channel"))
    names = links.groupBy().agg(F.collect_set("channel").alias("cs"))  # the channels are a fixed set of about ten
    grid = table(spark, sf_dir, "hypotheses").select("hypothesis_id").distinct().join(F.broadcast(names)).select("hypothesis_id", F.explode("cs").alias("channel"))
    counts = links.groupBy("hypothesis_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["hypothesis_id", "channel"], "left").select("hypothesis_id", "channel", F.coalesce("n", F.lit(0)).alias("n"), F.when(c("n") > 0, "ok").otherwise("no_results").alias("state"))


@query("select l.hypothesis_id, count(*) as n_links, count(*) filter (verdict = 'supports') as supports, count(*) filter (verdict = 'refutes') as refutes, count(*) filter (coalesce(verdict, '') not in ('supports', 'refutes')) as tangential, count(distinct channel) as n_channels, epoch_us(min(discovered_at)) as first_seen, epoch_us(max(discovered_at)) - epoch_us(min(discovered_at)) as elapsed from links l group by 1")
def batch_summary(spark, sf_dir):
    """Totals of each hypothesis's run: links, verdicts, channels, and the time between its first and last discovery."""
    v = F.coalesce("verdict", F.lit(""))
    first, last = F.unix_micros(F.min("discovered_at")), F.unix_micros(F.max("discovered_at"))
    return table(spark, sf_dir, "links").groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(v == "supports").alias("supports"), F.count_if(v == "refutes").alias("refutes"), F.count_if(~v.isin("supports", "refutes")).alias("tangential"), F.countDistinct("channel").alias("n_channels"), first.alias("first_seen"), (last - first).alias("elapsed"))


# --- sources --------------------------------------------------------------------------------------------
@query(f"with t as (select link_id, {strip_sql_blank('title')} as title from links) select min(link_id) as link_id from t where length(title) between 3 and 120 group by lower(title)")
def related_noise(spark, sf_dir):
    """Related searches of 3 to 120 characters, each once whatever its case."""
    links = table(spark, sf_dir, "links").select("link_id", U.strip(c("title")).alias("t")).where("length(t) between 3 and 120")
    return links.groupBy(F.lower("t").alias("k")).agg(F.min("link_id").alias("link_id")).select("link_id")


POSTS = [(1, '{"permalink": "/r/Tea/comments/1/x", "title": "A", "selftext": "' + "s" * 700 + '", "subreddit": "Tea", "score": 5, "num_comments": 2, "created_utc": 1700000000, "comments": [" one ", "two"]}'), (2, '{"permalink": "/r/b/2", "title": null, "selftext": "", "subreddit": "B", "score": 0, "num_comments": 0, "created_utc": 1700000001.0, "comments": []}'), (3, "broken"), (4, None)]


@query(f"""with v(id, payload) as ({values_sql(POSTS)}), p as (select id, payload->>'$.permalink' as link, payload->>'$.title' as title, payload->>'$.selftext' as body, payload->>'$.subreddit' as sub, payload->>'$.score' as score, payload->>'$.num_comments' as n, (payload->>'$.created_utc')::double as made, payload->>'$.comments[*]' as com from v where json_valid(payload))
select id, 'https://www.reddit.com' || link as url, coalesce(title, '') as title, length(substr(concat_ws(chr(10), nullif(substr(body, 1, 600), ''), '[r/' || sub || ' · ' || score || ' upvotes · ' || n || ' comments]', case when len(com) > 0 then 'Top comments: ' || array_to_string(list_transform(com[1:5], lambda x: trim(x)), ' // ') end), 1, 1500)) as snippet_length,
 (made * 1000000)::bigint as observed, 'subreddit:' || lower(sub) as tag from p""")
def scan_forum_posts(spark, sf_dir):
    """Posts of a forum's interface, replayed from their payloads."""
    from factloom.sources.replay import forum_posts

    posts = forum_posts(spark.createDataFrame(POSTS, "id int, payload string"))
    return posts.select("id", "url", "title", F.length("snippet").cast("bigint").alias("snippet_length"), F.unix_micros("observed_at").alias("observed"), c("signal_tags")[0].alias("tag"))


VIDEOS = [(1, '{"id": "abcdefghijk", "snippet": {"title": "T #Tea #tea", "channelTitle": "Ch", "publishedAt": "2024-05-01T10:00:00Z"}, "contentDetails": {"duration": "PT1M5S"}, "statistics": {"viewCount": "100", "likeCount": "7", "commentCount": "1"}}'), (2, '{"id": "b", "snippet": {"title": "U"}, "contentDetails": {"duration": "bad"}, "statistics": {"viewCount": "x"}}'), (3, "[]"), (4, None)]


@query(f"""with v(id, payload) as ({values_sql(VIDEOS)}), p as (select id, payload->>'$.id' as video, payload->>'$.snippet.title' as title, payload->>'$.snippet.channelTitle' as creator, payload->>'$.contentDetails.duration' as d, try_cast(payload->>'$.statistics.viewCount' as bigint) as v, try_cast(payload->>'$.statistics.likeCount' as bigint) as l, try_cast(payload->>'$.statistics.commentCount' as bigint) as k from v where json_valid(payload))
select id, video, title, creator, case when regexp_matches(d, '^PT(?:(\\d+)H)?(?:(\\d+)M)?(?:(\\d+)S)?$') then nullif(coalesce(try_cast(regexp_extract(d, '^PT(?:(\\d+)H)?(?:(\\d+)M)?(?:(\\d+)S)?$', 1) as int), 0) * 3600 + coalesce(try_cast(regexp_extract(d, '^PT(?:(\\d+)H)?(?:(\\d+)M)?(?:(\\d+)S)?$', 2) as int), 0) * 60 + coalesce(try_cast(regexp_extract(d, '^PT(?:(\\d+)H)?(?:(\\d+)M)?(?:(\\d+)S)?$', 3) as int), 0), 0) end as duration_sec,
 v as view_count, case when v > 0 then least(round_even((coalesce(l, 0) + 3 * coalesce(k, 0)) / v, 6), 1.0) end as engagement_score from p where video is not null""")
def scan_video_details(spark, sf_dir):
    """Details of videos, replayed from the payloads of their interface."""
    from factloom.sources.replay import video_details

    return video_details(spark.createDataFrame(VIDEOS, "id int, payload string")).select("id", "video", "title", "creator", "duration_sec", "view_count", "engagement_score")

