"""Rows that fail to parse: load the valid CSV records, set the others apart with a reason.

A block of records is parsed at once on pyarrow's columnar path. What
fails the column-wise tests, or is left alone when a block that does not parse is bisected, is
read by the strict character-level reader, which names the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import need, salted_join, ship

#: Target columns of an uploaded hypothesis file.
COLUMNS = (
    "hypothesis_id", "core_problem_id", "core_problem_statement", "statement", "dimension", "force_assignment",
    "investigation_priority", "expected_signals", "expected_counter_signals", "contrarian_pair_id", "rationale",
    "mece_cluster_id", "window_label", "max_triage",
)

# RE2 grammar of one record under RFC 4180: a field is fully quoted or free of quotes.
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_STRICT = rf"(?s)^{_FIELD}(?:,{_FIELD})*$"
_TRIAGE = r"^\s*0*(?:[1-9][0-9]?|100)\s*$"
_BLANK = r"^[\p{Z}\p{C}\s]*$"
_BLOCK = 8192


def _strip(text: str) -> str:
    """Trim visible and invisible blanks."""
    return text.strip().strip("​‌‍⁠﻿­").strip()


def read_strict(record: str) -> list[str] | None:
    """Fields of one record, or None if its quotes break RFC 4180. Line breaks outside quotes are plain characters."""
    fields, at, end = [], 0, len(record)
    while True:
        if at < end and record[at] == '"':
            out, at = [], at + 1
            while True:
                stop = record.find('"', at)
                if stop < 0:
                    return None
                out.append(record[at:stop])
                if record[stop + 1 : stop + 2] == '"':
                    out.append('"')
                    at = stop + 2
                else:
                    at = stop + 1
                    break
            if at < end and record[at] != ",":
                return None
            fields.append("".join(out))
        else:
            stop = record.find(",", at)
            stop = end if stop < 0 else stop
            if '"' in (field := record[at:stop]):
                return None
            fields.append(field)
            at = stop
        if at >= end:
            return fields
        at += 1


def header_names(header: str | None) -> list[str] | None:
    """Normalised column names of a header record; None when there is none or its quotes are broken."""
    if header is None:
        return None
    fields = read_strict(header.lstrip("﻿").removesuffix("\n").removesuffix("\r"))
    return fields and [re.sub(r"[\s\-]+", "_", _strip(f).lower()) for f in fields]


def diagnose(record: str | None, names: list[str] | None) -> tuple[str | None, list[str] | None]:
    """Reason and fields of a single record. Reason None with fields is valid, None without fields is a blank record."""
    fields = read_strict((record or "").removesuffix("\r"))
    if fields is None:
        return "quoting", None
    if not any(_strip(f) for f in fields):
        return None, None
    if names is None or len(fields) != len(names):
        return "columns", None
    row = dict(zip(names, fields, strict=True))
    triage = _strip(row.get("max_triage") or "")
    if not _strip(row.get("statement") or "") or (triage and not (re.fullmatch(r"[0-9]{1,400}", triage) and 1 <= int(triage) <= 100)):
        return "value", None
    return None, fields


@dataclass(frozen=True)
class Layout:
    """What the header of a batch asks of its records: the number of fields, and the place of each target column."""

    n: int
    places: tuple[int | None, ...]
    names: tuple[str, ...]

    @staticmethod
    def of(names: list[str]) -> Layout:
        at = {n: i for i, n in reversed(list(enumerate(names)))}
        return Layout(len(names), tuple(at.get(c) for c in COLUMNS), tuple(names))

    def place(self, column: str) -> int | None:
        return self.places[COLUMNS.index(column)]


def _bulk(records: list[str], layout: Layout) -> pa.Table | None:
    """The whole block as columns, or None if its records do not come out one to one."""
    data = "\n".join(f"{i},{r}" for i, r in enumerate(records)).encode("utf-8", "replace")
    cols = [f"c{i}" for i in range(layout.n + 1)]
    try:
        out = pacsv.read_csv(
            pa.BufferReader(data),
            read_options=pacsv.ReadOptions(column_names=cols, block_size=max(1 << 20, len(data) + 1), use_threads=False),
            parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(cols, pa.string()), strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if out.num_rows != len(records) or not out["c0"].combine_chunks().equals(pa.array([str(i) for i in range(len(records))])):
        return None
    return out


def _bisect(records: list[str], at: np.ndarray, layout: Layout) -> tuple[list[tuple[np.ndarray, pa.Table]], list[int]]:
    """Parsed blocks with the places of their records, and the places of the records that no block could take."""
    if not len(at):
        return [], []
    if (out := _bulk(records, layout)) is not None:
        return [(at, out)], []
    if len(at) == 1:
        return [], [int(at[0])]
    half = len(at) // 2
    left, right = _bisect(records[:half], at[:half], layout), _bisect(records[half:], at[half:], layout)
    return left[0] + right[0], left[1] + right[1]


def parse_block(records: pa.Array, layout: Layout | None) -> tuple[list[tuple[int, str]], list[tuple[np.ndarray, list[pa.Array | None]]]]:
    """(failures, loaded) of a block: (place, reason) of each bad record, and the valid ones as (places, target columns).

    The grammar, the number of fields and the values are tested column-wise over the whole block. Only what fails there, or
    stays alone when a block that does not parse is bisected, goes to the strict reader, which decides and names the reason."""
    clean = pc.replace_substring_regex(pc.fill_null(records.cast(pa.large_string()), ""), r"\r$", "")
    doubtful: list[int] = list(range(len(clean)))
    loaded: list[tuple[np.ndarray, list[pa.Array | None]]] = []
    if layout is not None:
        bare = pc.replace_substring_regex(clean, r'(?s)"(?:[^"]|"")*"', "")
        good = pc.and_(pc.match_substring_regex(clean, _STRICT), pc.equal(pc.count_substring(bare, ","), layout.n - 1)).to_numpy(zero_copy_only=False)
        doubtful = np.flatnonzero(~good).tolist()
        at = np.flatnonzero(good)
        blocks, lone = _bisect(clean.take(pa.array(at)).to_pylist(), at, layout)
        doubtful += lone
        statement, triage = layout.place("statement"), layout.place("max_triage")
        for where, out in blocks:
            # a blank statement may belong to a record that is blank altogether, so it too is decided below
            ok = np.zeros(len(where), bool) if statement is None else pc.invert(pc.match_substring_regex(out[f"c{statement + 1}"], _BLANK)).to_numpy()
            if triage is not None:
                value = out[f"c{triage + 1}"]
                ok &= pc.or_(pc.match_substring_regex(value, _TRIAGE), pc.match_substring_regex(value, r"^\s*$")).to_numpy()
            doubtful += where[~ok].tolist()
            kept = out if ok.all() else out.filter(pa.array(ok))
            loaded.append((where[ok], [None if p is None else kept[f"c{p + 1}"].combine_chunks() for p in layout.places]))
    failures = []
    for k in doubtful:
        reason, fields = diagnose(clean[k].as_py(), list(layout.names) if layout else None)
        if reason:
            failures.append((k, reason))
        elif fields:
            loaded.append((np.array([k]), [None if p is None else pa.array([fields[p]]) for p in layout.places]))
    return failures, loaded


def parse_records(lines: DataFrame, load: bool = True) -> DataFrame:
    """Every data record of ``lines`` (row_id, batch_id, line_no, raw_line) with the outcome of its parse.

    Columns out: row_id, batch_id, line_no, ``reason`` (null for a valid row, else
    quoting, columns or value) and the text columns of ``COLUMNS`` (null unless valid).
    Headers (line_no 1) and records whose fields are all blank give no row. A null
    raw_line counts as blank. A batch without a header cannot be matched: its
    records fail with 'columns'. A repeated header keeps the one of the smallest
    row_id. A null batch_id is a batch of its own. Other input columns are ignored.
    Without ``load`` the valid rows and the text columns are left out.
    """
    need(lines, ["row_id", "batch_id", "line_no", "raw_line"])
    ship(lines.sparkSession)
    lines = lines.select("row_id", "batch_id", "line_no", "raw_line", F.coalesce("batch_id", F.lit("\u0000")).alias("_batch"))
    headers = lines.where("line_no = 1").groupBy("_batch").agg(F.min_by("raw_line", "row_id").alias("_header"))
    data = salted_join(lines.where("line_no is null or line_no <> 1"), headers, "_batch", F.col("row_id"))

    kinds = dict(lines.dtypes)
    schema = f"row_id {kinds['row_id']}, batch_id string, line_no {kinds['line_no']}, reason string, " + ", ".join(f"{c} string" for c in COLUMNS if load)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Layout | None] = {None: None}
        for batch in batches:
            headers = batch.column("_header").dictionary_encode()
            layouts = []
            for h in headers.dictionary.to_pylist():
                if h not in known:
                    known[h] = Layout.of(names) if (names := header_names(h)) else None
                layouts.append(known[h])
            # batches of one layout share their blocks, whatever the spelling of their headers
            distinct = list(dict.fromkeys([*layouts, None]))
            number = np.array([distinct.index(x) for x in [*layouts, None]])
            group = number[pc.fill_null(headers.indices, len(layouts)).to_numpy(zero_copy_only=False)]
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                own = batch.take(pa.array(rows))
                for i in range(0, len(rows), _BLOCK):
                    yield from _outcomes(own.slice(i, _BLOCK), distinct[g], load)

    return data.select("row_id", "batch_id", "line_no", "raw_line", "_header").mapInArrow(run, schema.rstrip(", "))


def _outcomes(block: pa.RecordBatch, layout: Layout | None, load: bool) -> Iterator[pa.RecordBatch]:
    """Rows of parse_records for one block."""
    failures, loaded = parse_block(block.column("raw_line"), layout)
    names = ["row_id", "batch_id", "line_no", "reason", *(COLUMNS if load else ())]
    parts = [(np.array([k for k, _ in failures], np.int64), pa.array([r for _, r in failures], pa.string()), [None] * len(COLUMNS))]
    parts += [(at, pa.nulls(len(at), pa.string()), columns) for at, columns in loaded] if load else []
    for at, reason, columns in parts:
        if len(at):
            own = block.take(pa.array(at))
            texts = [pa.nulls(len(at), pa.string()) if c is None else c.cast(pa.string()) for c in columns] if load else []
            yield pa.RecordBatch.from_arrays([own.column("row_id"), own.column("batch_id"), own.column("line_no"), reason, *texts], names=names)


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The loaded rows, typed: max_triage as int, blank texts as null."""
    texts = [F.nullif(F.trim(c), F.lit("")).alias(c) for c in COLUMNS if c != "max_triage"]
    return parsed.where("reason is null").select("row_id", "batch_id", "line_no", *texts, F.expr("try_cast(trim(max_triage) as int)").alias("max_triage"))


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("row_id", "reason")
