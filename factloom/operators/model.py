"""A hook for model providers, and the validation of their answers. Without a provider every answer is null and the rules decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factloom.session import ship

VERDICTS = "struct<verdicts:array<struct<id:string,verdict:string,confidence:string,signal_tags:array<string>>>>"
QUOTE = "struct<quote:string,stance:string,relevance_score:string,cohort_evidenced:string,trigger_evidenced:string,attribute_evidenced:string,extractor_note:string>"
Provider = Callable[[list[str]], list[str | None]]


def ask(df: DataFrame, prompt: str, provider: Provider | None = None, batch: int = 6, answer: str = "answer") -> DataFrame:
    """df with the provider's answer to each prompt, called with at most ``batch`` prompts at a time; null without a provider, for a null
    prompt, and where the provider fails. The provider must be picklable."""
    if provider is None:
        return df.withColumn(answer, F.lit(None).cast("string"))
    ship(df.sparkSession)
    schema = StructType([*df.schema, StructField(answer, StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said: list[str | None] = [None] * len(part)
            asked = [(i, p) for i, p in enumerate(part[prompt]) if isinstance(p, str)]
            for at in range(0, len(asked), batch):
                some = asked[at : at + batch]
                try:
                    got = provider([p for _, p in some])
                except Exception:  # noqa: BLE001 — a failed call leaves the rules to decide
                    continue
                for (i, _), text in zip(some, got, strict=False):
                    said[i] = text
            yield part.assign(**{answer: pd.Series(said, index=part.index, dtype=object)})

    return df.mapInPandas(run, schema)


def verdict_rows(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(the columns of answers, id, verdict, confidence, signal_tags) of each usable verdict in a model's answer: a whole id, one of the three
    verdicts, confidence within 0 and 1 (0.5 where it is no number), tags trimmed in lower case. The last of one id counts."""
    each = answers.select("*", F.posexplode(F.from_json(answer, VERDICTS)["verdicts"]).alias("pos", "v")).withColumn("id", F.col("v.id").try_cast("int"))
    ok = each.where(F.col("id").isNotNull() & F.col("v.verdict").isin("supports", "refutes", "tangential"))
    conf = F.when(F.col("v.confidence").isNull(), 0.5).otherwise(F.coalesce(F.col("v.confidence").try_cast("double"), F.lit(0.5)))
    tags = F.filter(F.transform(F.coalesce("v.signal_tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    own = [c for c in answers.columns if c != answer]
    read = ok.select(*own, "id", "pos", F.col("v.verdict").alias("verdict"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"), tags.alias("signal_tags"))
    return read.groupBy(*own, "id").agg(F.max_by(F.struct("verdict", "confidence", "signal_tags"), "pos").alias("v")).select(*own, "id", "v.*")


def quote(answer: Column) -> Column:
    """A model's quote as a struct: trimmed, its stance one of three, its relevance within 0 and 1, fields cut to 80, 40, 40 and 200 characters; null for no JSON object."""
    q = F.from_json(answer, QUOTE)
    text = lambda f, n=None: (F.trim(F.coalesce(q[f], F.lit(""))) if n is None else F.substring(F.trim(F.coalesce(q[f], F.lit(""))), 1, n)).alias(f)
    stance = F.lower(F.trim(F.coalesce(q["stance"], F.lit("neutral"))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(q["relevance_score"].try_cast("double"), F.lit(0.0))))
    whole = F.struct(text("quote"), F.when(stance.isin("supports", "refutes", "neutral"), stance).otherwise("neutral").alias("stance"), score.alias("relevance_score"), text("cohort_evidenced", 80), text("trigger_evidenced", 40), text("attribute_evidenced", 40), text("extractor_note", 200))
    return F.when(F.trim(answer).startswith("{"), whole)
