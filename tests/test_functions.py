"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.operators import hypotheses as H


def value(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in columns.items())).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "url, want",
    [("https://WWW.YouTube.com:443//watch/?v=abc&utm_source=x&feature=share#t", "https://youtube.com/watch?v=abc"), ("http://a.com:8080/x/?b=2&a=1&c=", "http://a.com:8080/x?a=1&b=2"),
     ("https://a.com/?hsCtaTracking=1", "https://a.com/?hsCtaTracking=1"), (" plain text ", "plain text"), (None, "")],
)
def test_canonical_url(spark, url, want):
    assert value(spark, U.canonical_url(F.col("u")), u=url) == want
    if want:
        assert value(spark, U.canonical_url(F.col("u")), u=want) == want


@pytest.mark.parametrize("url, want", [("https://m.flipkart.com/p", "india"), ("https://x.co.in/", "india"), ("https://reddit.com/r/Mumbai/c", "india"), ("https://example.com/", "row"), ("", "unknown"), (None, "unknown")])
def test_geo(spark, url, want):
    assert value(spark, U.geo_scope(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, want", [("https://www.zepto.in/x", "quick_commerce"), ("https://fakeetsy.com/x", "ecom_global"), ("https://a.example/x", "other"), ("https://zillow.com", "other")])
def test_site_class(spark, url, want):
    assert value(spark, U.site_class(F.col("u")), u=url) == want


def test_clips_and_essays(spark):
    assert value(spark, U.clip_parts(F.col("u"))[1], u="https://m.tiktok.com/@a.b/video/12?x=1") == "https://www.tiktok.com/@a.b/video/12"
    assert value(spark, U.clip_parts(F.col("u"))[0], u="https://www.tiktok.com/@a.b") is None
    assert value(spark, U.essay_url(F.col("u")), u="https://me.substack.com/p/slug?x=1#y") == "https://me.substack.com/p/slug"
    assert value(spark, U.canonical_question(F.col("u")), u="https://quora.com/Why-x/answer/Me?y=1") == "https://quora.com/Why-x?y=1"


@pytest.mark.parametrize("text, want", [("PT15S", 15), ("PT1M30S", 90), ("PT2H3M4S", 7384), ("", None), ("x", None), ("PT0S", None)])
def test_iso_seconds(spark, text, want):
    assert value(spark, T.iso_seconds(F.col("t")), t=text) == want


def test_text(spark):
    assert value(spark, T.hashtags(F.col("t")), t="cornflakes are #boring #breakfast #BREAKFAST") == ["boring", "breakfast"]
    assert value(spark, T.strip_html(F.col("t")), t="<p>hello <b>world</b><script>x</script></p>") == "hello world"
    assert value(spark, T.clock_seconds(F.col("t")), t="length 1:02:03 long") == 3723
    assert value(spark, T.video_id(F.col("t")), t="https://youtu.be/abcdefghijk?x") == "abcdefghijk"
    assert value(spark, T.list_cell(F.col("t")), t="a|b ; c") == ["a", "b ; c"]
    assert value(spark, T.content_hash(F.col("t"), F.col("b")), t="short", b=None) is None
    assert value(spark, T.engagement(F.col("v"), F.col("l"), F.col("c")), v=1000, l=100, c=10) == 0.13


def test_hit_rate_and_verdict(spark):
    text = "the cornflakes were bland and boring; I stopped eating them."
    pattern = T.term_pattern(F.array(F.lit("bland"), F.lit("boring"), F.lit("stop")))
    assert value(spark, T.hit_rate(F.col("t"), pattern), t=text) == 0.2
    name, sure = T.verdict(F.col("t"), F.lit(0.01), F.lit(0.0))
    assert value(spark, name, t=text) == "supports" and value(spark, sure, t=text) == 0.75
    assert value(spark, T.verdict(F.col("t"), F.lit(0.0), F.lit(0.04))[0], t=text) == "refutes"
    assert value(spark, T.verdict(F.col("t"), F.lit(0.1), F.lit(0.0))[0], t="") == "tangential"


def test_hypothesis_words(spark):
    assert value(spark, H.archetype(F.col("s")), s="preference_for_alternatives") == "comparison"
    assert value(spark, H.archetype(F.col("s")), s="product_feature_gaps") == "narrative"
    assert [value(spark, H.geo_code(F.col("s")), s=s) for s in ("indian", "uk", "atlantis")] == ["IN", "UK", ""]
    assert value(spark, H.lexicon_hits(F.col("s"), H.ASPIRATIONS), s="premium self-care and fit") == ["fit", "premium", "self-care"]
