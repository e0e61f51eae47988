"""Hypotheses: packed cells, contrarian pairs, previews, lexicon scans, channel scores and query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import list_cell

# --- Fixed values -----------------------------------------------------------------------------
PAINS = (
    "bad bland boring broken complaint complaints complain complaining decline declining disappointed dropped expensive fail failing fake frustrating frustration "
    "garbage gap gaps hate hated horrible ignored irrelevant lacking lose losing lost mismatch misaligned missed outdated overpriced poor problem ripoff scam "
    "shrinking stale stopped stuck terrible tired trash ugly useless weak worse worst worsening"
).split()
ASPIRATIONS = (
    "active affordable aspirational authentic balance calm clean conscious convenient cool craft creative delicious eco elegant empowered energizing energy ethical "
    "exclusive fashionable fit fitness fresh fun gourmet happy healthy indulgent luxe luxury mindful modern natural nutritious organic pleasure premium pride "
    "productive refined satisfying savory self-care selfcare sleek stylish successful sustainable tasty traditional trendy trusted wellness"
).split()
IDENTITIES = (
    "athletes,athlete,boomers,boomer,dads,dad,diy,eco-conscious,ecoconscious,gamers,gamer,gen-z,gen z,genz,millennials,millennial,moms,mom,muslim,parents,parent,"
    "professionals,professional,seniors,senior,students,student,teens,teen,vegan,vegetarian,youth"
).split(",")
PLACES = (
    "indian,american,british,european,chinese,japanese,korean,german,french,italian,spanish,mexican,canadian,australian,russian,brazilian,south asian,latin,african,"
    "middle eastern,desi,india,usa,uk,u.s.,u.s.a.,us,china,japan,germany,france,brazil,russia,canada,australia,italy,spain,mexico,korea,north america,south america,europe,asia,"
    "africa,bengaluru,bangalore,mumbai,bombay,delhi,new delhi,ncr,gurugram,gurgaon,noida,chennai,madras,hyderabad,kolkata,calcutta,pune,ahmedabad,kochi,cochin,jaipur,"
    "lucknow,indore,chandigarh,surat,nagpur,thiruvananthapuram,trivandrum,vizag,visakhapatnam,coimbatore,vadodara"
).split(",")
ARCHETYPES = {
    "complaint": "sentiment", "complaints": "sentiment", "feedback": "sentiment", "satisfaction": "sentiment", "ratings": "sentiment", "rating": "sentiment",
    "review": "sentiment", "reviews": "sentiment", "sentiment": "sentiment", "feelings": "sentiment", "substitution": "comparison", "alternative": "comparison",
    "alternatives": "comparison", "vs": "comparison", "preference for alternatives": "comparison", "preferences": "comparison", "comparison": "comparison",
    "cross category": "comparison", "switching": "behavior", "repeat purchase": "behavior", "purchase": "behavior", "purchases": "behavior", "subscription": "behavior",
    "rate": "behavior", "rates": "behavior", "stickiness": "behavior", "loyalty": "behavior", "usage": "behavior", "adoption": "behavior", "narrative": "narrative",
    "narratives": "narrative", "stories": "narrative", "framing": "narrative", "gap": "narrative", "gaps": "narrative", "feature gaps": "narrative",
    "consideration set": "narrative", "demographic": "demographic", "demographics": "demographic", "cohort": "demographic", "generation": "demographic",
    "age": "demographic", "audience": "demographic", "price": "price", "prices": "price", "pricing": "price", "elasticity": "price", "cost": "price",
}
GEO_CODES = {
    "india": "IN", "indian": "IN", "bharat": "IN", "usa": "US", "america": "US", "american": "US", "britain": "GB", "british": "GB", "england": "GB", "english": "GB",
    "canada": "CA", "canadian": "CA", "australia": "AU", "australian": "AU", "germany": "DE", "german": "DE", "france": "FR", "french": "FR", "japan": "JP",
    "japanese": "JP", "china": "CN", "chinese": "CN", "brazil": "BR", "brazilian": "BR", "mexico": "MX", "mexican": "MX", "south africa": "ZA", "indonesia": "ID",
    "indonesian": "ID", "philippines": "PH", "filipino": "PH", "uae": "AE", "emirates": "AE", "singapore": "SG", "singaporean": "SG",
}
# ----------------------------------------------------------------------------------------------


def lexicon_hits(text: Column, terms: list[str], keep_order: bool = False) -> Column:
    """Terms found in a text: whole words for plain terms, substrings for terms with a blank or hyphen; sorted,
    or in the order of the list. Null gives an empty array."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(low, r"[^\p{L}\p{N}_]+")
    if keep_order:
        return F.filter(F.array(*map(F.lit, terms)), lambda t: F.when(t.rlike("[ -]"), low.contains(t)).otherwise(F.array_contains(words, t)))
    single, multi = [t for t in terms if " " not in t and "-" not in t], [t for t in terms if " " in t or "-" in t]
    found = F.array_intersect(F.array(*map(F.lit, single)), words)
    if multi:
        found = F.concat(found, F.filter(F.array(*map(F.lit, multi)), lambda t: low.contains(t)))
    return F.array_sort(found)


def archetype(signal: Column) -> Column:
    """Archetype of the longest keyword within a signal; equal lengths take the earlier keyword; else other."""
    low = F.lower(F.replace(signal, F.lit("_"), F.lit(" ")))
    out = None
    for k in sorted(ARCHETYPES, key=lambda k: -len(k)):  # stable: list order within a length
        hit = low.contains(k)
        out = F.when(hit, ARCHETYPES[k]) if out is None else out.when(hit, ARCHETYPES[k])
    return out.otherwise("other")


def geo_code(hint: Column) -> Column:
    """Country code of a place name; two letters pass through in upper case (so uk stays UK); '' if unknown."""
    low = F.lower(F.trim(hint))
    table = F.create_map(*[F.lit(x) for kv in GEO_CODES.items() for x in kv])
    return F.when(low.rlike("^[a-z]{2}$"), F.upper(low)).otherwise(F.coalesce(F.try_element_at(table, low), F.lit("")))


def pairs(hypotheses: DataFrame) -> DataFrame:
    """Contrarian pairs of which both sides exist, each once, the smaller id first."""
    a = hypotheses.select(F.col("hypothesis_id").alias("a"), F.col("contrarian_pair_id").alias("b")).where("b is not null and a <> b")
    ids = hypotheses.select(F.col("hypothesis_id").alias("b")).distinct()
    return a.join(ids, "b", "left_semi").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def preview(hypotheses: DataFrame) -> DataFrame:
    """Core problems with their number of hypotheses, first statement that is not blank, ids in order, and hypotheses without a statement."""
    df = hypotheses.withColumn("core_problem_id", F.coalesce(F.nullif(F.trim("core_problem_id"), F.lit("")), F.lit("_uncategorized")))
    said = F.nullif(F.trim("core_problem_statement"), F.lit(""))
    return df.groupBy("core_problem_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(said, F.when(said.isNotNull(), F.col("hypothesis_id"))).alias("statement"),
        F.array_join(F.array_sort(F.collect_list("hypothesis_id")), ",").alias("hypothesis_ids"), F.count_if(F.coalesce(F.trim("statement"), F.lit("")) == "").alias("without_statement"),
    )


def decompose(hypotheses: DataFrame, context: dict | None = None) -> DataFrame:
    """Each hypothesis taken apart: primary_entity, competitors, pains, aspirations, identities, places, topics, signals.

    ``context`` is what a manifest gives (brand, competitors, geo, cohorts, topics): the brand replaces the first entity, competitors and places of the
    manifest come first (eight competitors at most), its cohorts and topics last (24 topics at most)."""
    from factloom.operators import manifest as M
    from factloom.operators import topics as P

    given = lambda k: F.array(*map(F.lit, (context or {}).get(k) or [])).cast("array<string>")
    brand = F.lit((context or {}).get("brand"))
    text = F.concat_ws(" ", "statement", "rationale", "core_problem_statement")
    found = hypotheses.withColumn("_e", M.named_entities(F.coalesce(P.entities(F.col("statement")), F.array().cast("array<string>"))))
    rest = F.filter(F.slice("_e", 2, 1000), lambda x: F.lower(x) != F.lower(F.coalesce(brand, F.lit(""))))
    topics = F.slice(F.array_union(P.topics(text), given("topics")), 1, 24)
    return found.select(
        "hypothesis_id", F.coalesce(brand, P.primary(F.col("_e"))).alias("primary_entity"), F.slice(F.array_union(given("competitors"), rest), 1, 8).alias("competitors") if context else rest.alias("competitors"),
        lexicon_hits(text, PAINS).alias("pains"), lexicon_hits(text, ASPIRATIONS).alias("aspirations"), F.array_union(lexicon_hits(text, IDENTITIES, True), given("cohorts")).alias("identities"),
        F.array_union(given("geo"), lexicon_hits(text, sorted(PLACES, key=lambda t: (-len(t), t)), True)).alias("places"), topics.alias("topics"), list_cell(F.coalesce("expected_signals", F.lit(""))).alias("signals"),
    )


def signal_rows(hypotheses: DataFrame) -> DataFrame:
    """(hypothesis_id, pos, signal) of the expected signals, by the plain packed-cell rule."""
    return hypotheses.select("hypothesis_id", F.posexplode(list_cell(F.col("expected_signals"))).alias("pos", "signal"))


def score_channels(hypotheses: DataFrame, weights: DataFrame, forbidden: DataFrame | None = None, threshold: float = 50, top: int = 5) -> DataFrame:
    """Channels of each hypothesis by a weighted score, best first.

    ``weights`` holds (dimension, channel, channel_ord, affinity, base): the score is
    half-even round(0.6 affinity + 0.4 base), missing terms 0. Forbidden (force_assignment,
    channel) pairs are removed; ties keep the channel order. The weights are a parameter; the side is a
    table of dimensions by channels.
    """
    joined = hypotheses.select("hypothesis_id", "dimension", "force_assignment").join(weights, "dimension")
    if forbidden is not None:
        joined = joined.join(forbidden, ["force_assignment", "channel"], "left_anti")
    scored = joined.withColumn("score", F.bround(F.coalesce("affinity", F.lit(0.0)) * 0.6 + F.coalesce("base", F.lit(0.0)) * 0.4).cast("int")).where(F.col("score") >= threshold)
    w = Window.partitionBy("hypothesis_id").orderBy(F.desc("score"), "channel_ord")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("hypothesis_id", "channel", "score", "place")
