"""What the texts of a manifest name: competitors, prices, regulators, cohorts, life events, attributes, places. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.operators.hypotheses import ASPIRATIONS, IDENTITIES, PAINS, PLACES
from factloom.operators.topics import HEAD_WORDS, ROLE_NOUNS

# --- Fixed values -----------------------------------------------------------------------------
PHRASES = (
    r"(?i)\b(?:key\s+)?competitors?\s+(?:are|is|include[ds]?|comprise[ds]?)\s+([^.;]+)",
    r"(?i)\b(?:compete[ds]?\s+(?:with|against)|going\s+up\s+against)\s+([^.;]+)",
    r"(?i)\b(?:rivals?|key\s+rivals?)\s+(?:are|include[ds]?)\s+([^.;]+)",
)
PRICE = r"(?i)\b(?:INR|Rs\.?|₹|\$|USD|GBP|£|EUR|€)\s*[\d.,]+(?:\s*(?:crore|lakh|million|billion|k))?"
REGULATORS = {
    "RERA": "india", "FDA": "us", "FCC": "us", "FTC": "us", "SEBI": "india", "RBI": "india", "GDPR": "europe", "HIPAA": "us", "CCPA": "us",
    "FSSAI": "india", "TRAI": "india", "IRDAI": "india", "IPO": None, "MCA": None,
}
CURRENCIES = {"INR": "india", "RS": "india", "₹": "india", "USD": "us", "GBP": "uk", "EUR": "europe", "€": "europe"}
TRIGGERS = (
    "marriage,wedding,engaged,birth,newborn,baby,moving,relocat,transfer,retirement,retire,pension,promotion,salary hike,salary increase,raise,graduation,first job,starting career,"
    "divorce,separation,death,bereavement,inheritance,diagnosis,illness,school admission,college admission,going abroad,emigration,immigration,buying first home,first home,empty nest,kids leaving"
).split(",")
SEGMENTS = "HNI,HNIs,High Net-worth Individuals,high net worth,Gen Z,Gen-Z,millennial,millennials,boomer,salaried,self-employed,student,retiree,first-time buyer,first-time homebuyer".split(",")
AGES = r"(?i)(?:\S+\s+)?(?:\S+\s+)?(?:\S+\s+)?(?:aged?|ages?)\s+\d{2}\s*[-–to]+\s*\d{2}\b"
AGE_TAIL = r"(?i)(?:aged?|ages?)\s+(\d{2})\s*[-–to]+\s*(\d{2})$"
FILLERS = "are is for of and or to from with without the a an".split()
SUFFIXES = "aware based centric driven first focused free friendly heavy ish led light like oriented powered ready rich".split()
STANDS_FOR = r"(?i)(?:is\s+one\s+of|perceived\s+as|stands\s+for|represents?)\s+([^.]+)"
CITIES = PLACES[PLACES.index("bengaluru") :]
# ----------------------------------------------------------------------------------------------
BLOCKED = sorted({*PAINS, *ASPIRATIONS, *IDENTITIES, *PLACES, *ROLE_NOUNS, *HEAD_WORDS})
STOPS = sorted({*ROLE_NOUNS, *HEAD_WORDS})


def once(items: Column) -> Column:
    """Items without those that repeat an earlier one in other case."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def competitors(text: Column) -> Column:
    """Capitalised names listed after a phrase that introduces competitors; the first kind of phrase that occurs decides."""
    tail = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in PHRASES])
    bare = F.regexp_extract(tail, r"(?s)^(.*?)(?:\b(?:in|on|this|that|over|since|across)\b|$)", 1)
    parts = F.transform(F.split(bare, r"\s*,\s*|\s*\band\b\s*|\s*&\s*"), lambda p: F.regexp_replace(F.regexp_replace(p, r"^[\s.;:]+|[\s.;:]+$", ""), r"(?i)^(?:and|or)\s+", ""))
    return F.coalesce(once(F.filter(parts, lambda p: (F.length(p) >= 3) & p.rlike(r"^\p{Lu}") & ~F.lower(p).isin(*STOPS))), F.array().cast("array<string>"))


def prices(text: Column) -> Column:
    """Up to eight amounts with a currency."""
    return F.slice(once(F.transform(F.regexp_extract_all(text, F.lit(f"({PRICE})"), 1), lambda x: F.trim(x))), 1, 8)


def regulators(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(REGULATORS)})\b"), 1))


def triggers(text: Column) -> Column:
    """Life events named in a text, longer names first."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, sorted(TRIGGERS, key=lambda t: -len(t)))), low.contains)


def cohorts(text: Column) -> Column:
    """Groups with an age range, with up to three words before it, then the named segments."""

    def named(m: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(F.regexp_replace(m, AGE_TAIL, ""), rf"(?i)^(?:(?:{'|'.join(FILLERS)})\s+)+", "")), r"\s+")
        ages = F.concat(F.lit("aged "), F.regexp_extract(m, AGE_TAIL, 1), F.lit("-"), F.regexp_extract(m, AGE_TAIL, 2))
        return F.concat_ws(" ", F.filter(words, lambda w: w.rlike(r"^\p{L}")), ages)

    low = F.lower(text)
    ranges = F.transform(F.regexp_extract_all(text, F.lit(f"({AGES})"), 1), named)
    return once(F.concat(ranges, F.filter(F.array(*map(F.lit, SEGMENTS)), lambda s: low.contains(F.lower(s)))))


def attributes(text: Column) -> Column:
    """Up to six adjectives of what a brand is said to stand for."""
    said = F.nullif(F.regexp_extract(text, STANDS_FOR, 1), F.lit(""))
    clean = F.transform(F.split(said, r"\s*,\s*|\s+and\s+|\s*&\s*"), lambda p: F.regexp_replace(F.lower(F.regexp_replace(p, r"^[\s.;:]+|[\s.;:]+$", "")), r"^(?:and|or|the|a|an|of|in)\s+", ""))
    return F.coalesce(F.slice(F.array_distinct(F.filter(clean, lambda p: F.length(p) >= 3)), 1, 6), F.array().cast("array<string>"))


def _lookup(table: dict[str, str | None]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() if v for x in (k, v)])


def geo_hints(text: Column) -> Column:
    """Regions by currency, by regulator, and by city (each city, then its country)."""
    marks = F.regexp_extract_all(text, F.lit(r"(?i)\b(INR|Rs|₹|\$|USD|GBP|£|EUR|€)\.?\s*[\d.,]+"), 1)
    money = F.transform(marks, lambda m: F.try_element_at(_lookup(CURRENCIES), F.upper(m)))
    law = F.transform(regulators(text), lambda m: F.try_element_at(_lookup(REGULATORS), m))
    low = F.lower(text)
    cities = F.filter(F.array(*map(F.lit, CITIES)), low.contains)
    country = F.when(F.size(cities) > 0, F.array(F.lit("india"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(money, law, cities, country), lambda x: x.isNotNull()))


def named_entities(found: Column) -> Column:
    """Entities without words of the lexicons, without shorter forms of a possessive, and without parts of longer ones."""
    low_parts = lambda e: F.split(F.lower(e), "-")
    plain = F.filter(found, lambda e: (
        ~F.lower(e).isin(*BLOCKED) & ((F.length(e) >= 3) | e.contains(" "))
        & ~(e.contains("-") & (F.exists(low_parts(e), lambda p: p.isin(*BLOCKED)) | ((F.size(low_parts(e)) == 2) & F.element_at(low_parts(e), -1).isin(*SUFFIXES))))
        & ~F.lower(F.substring_index(e, " ", 1)).isin(*STOPS)
    ))
    root = lambda s: F.trim(F.regexp_replace(F.lower(s), "['’]s?$", ""))
    norm = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    lone = F.transform(F.array(plain), lambda p: F.filter(p, lambda e: ~F.exists(p, lambda o: (o != e) & (root(F.substring_index(o, " ", 1)) == root(e)) & (F.length(o) > F.length(e)))))[0]

    def whole(p: Column) -> Column:
        named = F.transform(p, lambda e, i: F.struct(e.alias("e"), norm(e).alias("n"), i.alias("i")))
        inside = lambda a, b: F.concat(F.lit(" "), b["n"], F.lit(" ")).contains(F.concat(F.lit(" "), a["n"], F.lit(" ")))
        kept = F.filter(named, lambda a: (a["n"] == "") | ~F.exists(named, lambda b: (a["i"] != b["i"]) & (b["n"] != "") & (((F.length(b["n"]) > F.length(a["n"])) & inside(a, b)) | ((b["n"] == a["n"]) & (b["i"] < a["i"])))))
        return F.transform(kept, lambda a: a["e"])

    return F.transform(F.array(lone), whole)[0]


def merged(own: Column, given: Column, most: int | None = None, given_first: bool = True) -> Column:
    """Two lists as one without repeats; the given one first unless told otherwise."""
    both = F.array_union(given, own) if given_first else F.array_union(own, given)
    return F.slice(both, 1, most) if most else both
