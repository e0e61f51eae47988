"""Records that fail to parse: strict reader, bisection, and the operator on odd tables."""

import csv
import io

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators import badrows as B

NAMES = ["statement", "max_triage", "rationale"]


@pytest.mark.parametrize(
    "record, fields",
    [("a,b", ["a", "b"]), ('"a,1",b', ["a,1", "b"]), ('"say ""x""",', ['say "x"', ""]), ('"a\nb",c', ["a\nb", "c"]), ("", [""]), ('a"b,c', None), ('"a" b,c', None), ('"a,b', None), ('"a\\"b",c', None)],
)
def test_read_strict(record, fields):
    assert B.read_strict(record) == fields


@pytest.mark.parametrize(
    "record, reason",
    [("s,5,n", None), ("s,,n", None), ("s, 60 ,n", None), ("s,007,n", None), ('s,5,"n"\r', None), (" ,5,n", "value"), ("s,0,n", "value"), ("s,101,n", "value"), ("s,1e1,n", "value"), ("s,12.0,n", "value"),
     ("s,٣,n", "value"), ("s,+5,n", "value"), ("s,5", "columns"), ("s,5,n,x", "columns"), ('s,"5" x,n', "quoting"), ("s,5,n\ns,5,n", "columns")],
)
def test_reasons(record, reason):
    got, fields = B.diagnose(record, NAMES)
    assert got == reason and (fields is None) == (reason is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",\n \r5', max_size=6), min_size=1, max_size=4), max_size=25), st.booleans())
def test_blocks_equal_single_records(rows, quoted):
    records = []
    for r in rows:
        if quoted:
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow(r)
            records.append(out.getvalue())
        else:
            records.append(",".join(r))
    layout = B.Layout.of(NAMES)
    failures, loaded = B.parse_block(pa.array(records, pa.string()), layout)
    got = {k: (reason, None) for k, reason in failures}
    for at, columns in loaded:
        texts = {c: columns[B.COLUMNS.index(c)].to_pylist() for c in NAMES if c in B.COLUMNS}
        got |= {int(k): (None, {c: v[i] for c, v in texts.items()}) for i, k in enumerate(at)}
    for k, r in enumerate(records):
        reason, fields = B.diagnose(r, NAMES)
        if reason or fields:
            assert got.pop(k) == (reason, fields and {c: f for c, f in zip(NAMES, fields, strict=True) if c in B.COLUMNS})
    assert not got


def test_operator(spark):
    schema = "row_id long, batch_id string, line_no int, raw_line string, reason string"
    rows = [(1, "a", 1, "﻿Statement,Max Triage", "x"), (2, "a", 2, "s,5", None), (3, "a", 3, None, None), (4, "a", 4, "s", None), (5, "a", 2, "s,5", None), (6, "b", 2, "s,5", None),
            (7, None, 1, "statement", None), (8, None, 2, "t" * 200_000, None), (9, "a", 5, ",", None)]
    got = {r.row_id: r.reason for r in B.parse_records(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: None, 4: "columns", 5: None, 6: "columns", 8: None}
    loaded = B.valid_rows(B.parse_records(spark.createDataFrame(rows, schema)))
    assert {(r.row_id, r.max_triage) for r in loaded.collect()} == {(2, 5), (5, 5), (8, None)}
    assert B.parse_records(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError, match="raw_line"):
        B.parse_records(spark.createDataFrame([(1,)], "row_id long"))
