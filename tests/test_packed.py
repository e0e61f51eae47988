"""Packed values: tokenizer cases, a round trip, and the operator on odd tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators.packed import split_values, unpack_fields


@pytest.mark.parametrize(
    "text, values",
    [("a|b ; c", ["a", "b ; c"]), ("a;b,c", ["a", "b,c"]), ('"a|b";c', ["a|b", "c"]), ('"the ""x"" y"; z', ['the "x" y', "z"]), ("['a', 'b, c']", ["a", "b, c"]), ('["a; b","say \\"x\\""]', ["a; b", 'say "x"']),
     ("a||b|", ["a", "b"]), ("a\nb\r\nc", ["a", "b", "c"]), ("a\tb", ["a", "b"]), ('"a |b"', ["a |b"]), ("don't; won't", ["don't", "won't"]), ('"open; end', ['"open', "end"]), (None, []), ("  ", []), ("|;,", [";,"]), ("f(a,b);c", ["f(a,b)", "c"])],
)
def test_split(text, values):
    assert split_values(text) == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab"|;, x', min_size=1, max_size=8), min_size=1, max_size=6), st.sampled_from("|;,"))
def test_round_trip(values, sep):
    packed = sep.join('"' + v.replace('"', '""') + '"' for v in values)
    assert split_values(packed) == [v.strip() for v in values if v.strip()]


def test_operator(spark):
    rows = [("h1", "a|b", None, "a"), ("h1", "a|b", None, "a"), (None, "x", "", "a"), ("h2", "v;" * 100_000, "y", "a")]
    df = spark.createDataFrame(rows, "hypothesis_id string, s string, t string, field_name string")
    got = unpack_fields(df, "hypothesis_id", ["s", "t"])
    assert got.where("hypothesis_id = 'h1'").count() == 4 and got.where("hypothesis_id is null").count() == 1
    assert got.where("hypothesis_id = 'h2' and field_name = 's'").agg({"value_no": "max"}).first()[0] == 100_000
    assert unpack_fields(df.limit(0), "hypothesis_id", ["s", "t"]).count() == 0
