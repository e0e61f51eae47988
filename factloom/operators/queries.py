"""Search texts of hypotheses: slots filled into template families, for all hypotheses in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import hypotheses as H
from factloom.operators import topics as P

#: Default dimension, roles and years of the templates. Fixed values.
DIMENSION, ROLES, YEARS = "health", ("expert", "nutritionist"), ("2024", "2025")
CAP = 18


def slots(hypotheses: DataFrame) -> DataFrame:
    """(hypothesis_id, brand, alternatives, pains, aspirations, category): what the templates are filled with."""
    text = F.concat_ws(" ", "statement", "rationale", "core_problem_statement")
    found = hypotheses.select("hypothesis_id", P.entities(F.col("statement")).alias("e"), text.alias("t"))
    named = found.select(
        "hypothesis_id", F.lower(P.primary(F.col("e"))).alias("brand"), F.transform(F.slice("e", 2, 5), F.lower).alias("alternatives"),
        H.lexicon_hits(F.col("t"), H.PAINS).alias("pains"), H.lexicon_hits(F.col("t"), H.ASPIRATIONS).alias("aspirations"), F.try_element_at(P.topics(F.col("t")), F.lit(1)).alias("topic"),
    )
    return named.withColumn("category", F.coalesce("topic", "brand")).drop("topic")


def texts() -> dict[int, Column]:
    """Array of texts by archetype: pain, switching, comparison, aspiration, counter, expert, crisis."""
    b, cat = F.col("brand"), F.col("category")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return {
        1: F.when(F.size("pains") > 0, F.transform(F.slice("pains", 1, 3), lambda p: say(b, " ", p))).otherwise(F.array(say(b, " review negative"))),
        2: F.transform(F.slice("alternatives", 1, 3), lambda a: say("why i switched from ", b, " to ", a)),
        3: F.transform(F.slice("alternatives", 1, 3), lambda a: say(b, " vs ", a, f" {DIMENSION}")),
        4: F.transform(F.slice("aspirations", 1, 2), lambda a: say("best ", cat, " for ", a)),
        6: F.array(say("why i love ", b), say(b, " is actually good")),
        7: F.array(*[say(cat, f" {r}") for r in ROLES]),
        8: F.array(*[say(b, f" {y}") for y in YEARS], say(b, " controversy")),
    }


def synthesize(hypotheses: DataFrame) -> DataFrame:
    """(hypothesis_id, pos, archetype, text): texts in order of archetype, each once, at most CAP. Archetype 6 is the
    falsifier. Hypotheses without an entity give no text."""
    named = slots(hypotheses).where("brand is not null")
    tagged = lambda a: lambda x: F.struct(F.lit(a).alias("archetype"), x.alias("text"))
    rows = F.concat(*[F.transform(t, tagged(a)) for a, t in texts().items()])
    each = named.select("hypothesis_id", F.posexplode(rows).alias("i", "r")).select("hypothesis_id", "i", "r.*")
    first = each.groupBy("hypothesis_id", "text").agg(F.min(F.struct("i", "archetype")).alias("f")).select("hypothesis_id", "text", "f.*")
    # at most some twenty texts a hypothesis
    listed = first.groupBy("hypothesis_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("i", "archetype", "text"))), 1, CAP).alias("l"))
    return listed.select("hypothesis_id", F.posexplode("l").alias("pos", "r")).select("hypothesis_id", "pos", "r.archetype", "r.text")
