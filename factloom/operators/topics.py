"""Entities and topics of hypotheses, by capitalised phrases and term lists. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.operators.hypotheses import PLACES

# --- Fixed values -----------------------------------------------------------------------------
HEAD_WORDS = (
    "the a an this that these those why what how where when who which is are was were be been in on at and or but for to of by with "
    "given proving directly building adding noting considering leveraging according regarding based however moreover furthermore therefore thus hence "
    "indeed still yet also additionally specifically such many most some any all every each no yes not none neither either both "
    "his her their its our your my we they it he she us them him i do does did will would could should shall may might must can has have had "
    "more less much very too so just only even ever never always often sometimes if unless while though although because since"
).split()
ROLE_NOUNS = (
    "prospects prospect customers customer users user buyers buyer clients client consumers consumer shoppers shopper people person individuals individual "
    "audiences audience members member subscribers subscriber viewers viewer readers reader listeners listener fans fan followers follower respondents respondent "
    "participants participant brands brand companies company competitors competitor competition developers developer developments development agents agent vendors "
    "vendor suppliers supplier retailers retailer manufacturers manufacturer providers provider operators operator households household families family stakeholders "
    "stakeholder decision decisions purchase purchases purchasing purchaser fgds fgd pestle swot tam sam som"
).split()
TOPICS = (
    "real estate,property,properties,apartment,apartments,flat,flats,villa,villas,house,houses,home,homes,amenities,amenity,micro-market,micromarket,developer,luxury,premium,"
    "affordable housing,residential,commercial,site visit,site-visit,floor plan,carpet area,rera,possession,booking,down payment,emi,hotel,hotels,flight,flights,vacation,trip,"
    "travel,homestay,resort,package tour,breakfast,cereal,snack,snacks,beverage,beverages,packaged food,instant,ready-to-eat,pricing,positioning,product,feature,features,"
    "design,purchase,buyer,shopper,review,reviews,experience,service,support,warranty,delivery,investment,value,quality,trust,satisfaction,complaint,complaints,feedback,decision"
).split(",")
# ----------------------------------------------------------------------------------------------

#: A run of capitalised words.
CAPITALISED = r"([A-Z][A-Za-z0-9'’&-]*(?:\s+[A-Z][A-Za-z0-9'’&-]*)*)"


def entities(text: Column) -> Column:
    """Capitalised phrases of a text in order, without leading function words, places and role nouns; each once, whatever its case."""
    found = F.regexp_extract_all(text, F.lit(r"\b" + CAPITALISED), 1)
    head = lambda s: F.lower(F.substring_index(s, " ", 1))
    cut = F.transform(found, lambda s: F.when(head(s).isin(*HEAD_WORDS), F.regexp_replace(s, r"^\S+\s*", "")).otherwise(s))
    kept = F.filter(cut, lambda s: (F.length(s) >= 3) & ~F.lower(s).isin(*HEAD_WORDS) & ~F.lower(s).isin(*PLACES) & ~head(s).isin(*ROLE_NOUNS))
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)


def primary(found: Column) -> Column:
    """The entity that stands first; the rest are competitors."""
    return F.try_element_at(found, F.lit(1))


def topics(text: Column, most: int = 12) -> Column:
    """Domain terms of a text, longer ones first, at most ``most``."""
    low = F.lower(text)
    words = F.split(low, r"[^\p{L}\p{N}_]+")
    terms = sorted(dict.fromkeys(TOPICS), key=lambda t: -len(t))
    hits = F.filter(F.array(*map(F.lit, terms)), lambda t: F.when(t.rlike("[ -]"), low.contains(t)).otherwise(F.array_contains(words, t)))
    return F.slice(hits, 1, most)
