"""Several values packed in one field: a quote-aware tokenizer with one row per value."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import need, ship

#: Separators in order of rank: a field uses the first of these groups that occurs outside quotes. A slash separates
#: only between blanks, as it also stands inside words.
SEPARATORS = ("|¦｜", ";；", "•·‣", "/", ",，、", "\n\r", "\t")
_MARKS = frozenset("".join(SEPARATORS))
_BLANK = " \t\r\n ​⁠﻿"
_PAIRS = {"[": "]", "(": ")", "{": "}"}


def scan(text: str) -> tuple[list[tuple[int, str]], int]:
    """One pass of the automaton. Returns the separators seen outside quotes and outside
    inner brackets as (offset, character), and the depth the text ended in.

    A quote opens only where a value can begin (at the start, or behind a separator,
    a bracket or blanks that follow one); inside it, a doubled quote or a backslash
    keeps it open. A quote that never closes is plain text.
    """
    marks: list[tuple[int, str]] = []
    i, n, fresh, depth = 0, len(text), True, 0
    while i < n:
        c = text[i]
        if fresh and c in "\"'":
            j = i + 1
            while j < n:
                if text[j] == "\\" and j + 1 < n:
                    j += 2
                elif text[j] == c:
                    if text[j + 1 : j + 2] == c:
                        j += 2
                        continue
                    break
                else:
                    j += 1
            if j < n:
                i, fresh = j + 1, False
                continue
        if c in _MARKS and depth <= 0 and (c != "/" or (text[i - 1 : i].isspace() and text[i + 1 : i + 2].isspace())):
            marks.append((i, c))
            fresh = True
        elif c in "[({":
            depth += 1
        elif c in "])}":
            depth -= 1
        elif c not in _BLANK:
            fresh = False
        i += 1
    return marks, depth


def _value(raw: str) -> str:
    """A value without surrounding blanks and enclosing quotes, inner quotes as written once."""
    v = raw.strip(_BLANK)
    if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'":
        q = v[0]
        out, i, inner = [], 0, v[1:-1]
        while i < len(inner):
            if inner[i] == "\\" and inner[i + 1 : i + 2] in (q, "\\"):
                out.append(inner[i + 1])
                i += 2
            elif inner.startswith(q + q, i):
                out.append(q)
                i += 2
            else:
                out.append(inner[i])
                i += 1
        v = "".join(out).strip(_BLANK)
    return v


def split_values(text: str | None) -> list[str]:
    """Non-empty values of one packed field, in order."""
    if text is None:
        return []
    body = text.strip(_BLANK)
    if len(body) >= 2 and _PAIRS.get(body[0]) == body[-1]:
        inner = body[1:-1]
        if scan(inner)[1] == 0:
            body = inner.strip(_BLANK)
    marks, depth = scan(body)
    if depth:  # unbalanced brackets are plain characters
        marks, _ = scan("".join("." if c in "[](){}" else c for c in body))
    for group in SEPARATORS:
        cuts = [i for i, c in marks if c in group]
        if cuts:
            parts = [body[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(body)], strict=True)]
            break
    else:
        parts = [body]
    return [v for v in map(_value, parts) if v]


def unpack_fields(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One row per packed value: (id_col, field_name, value_no, value_text).

    Null, empty and all-blank fields give no row; repeated ids and repeated values
    keep all their rows; columns other than the id and the fields are ignored.
    The pass is narrow: no shuffle, one task's memory holds one Arrow batch.
    """
    ship(df.sparkSession)
    need(df, [id_col, *fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, names, numbers, values = [], [], [], []
            for f in fields:
                for key, text in zip(part[id_col], part[f], strict=True):
                    if isinstance(text, str) and text:
                        got = split_values(text)
                        ids += [key] * len(got)
                        names += [f] * len(got)
                        numbers += range(1, len(got) + 1)
                        values += got
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=part[id_col].dtype), "field_name": names, "value_no": pd.Series(numbers, dtype="int32"), "value_text": values})

    return df.select(id_col, *[F.col(f).cast("string").alias(f) for f in fields]).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, field_name string, value_no int, value_text string")
