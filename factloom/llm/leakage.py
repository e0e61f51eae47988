"""Evaluation passages inside training text: q-gram lemma filter over diagonal bands, then banded alignment."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, need, ship, widen

#: Length of the q-grams.
Q = 10
#: The edit budget of a stretch of n characters: at most EDITS * n of them changed, in at most RUNS * n runs, as whole words are
#: changed at once. A run of r changed characters spoils at most r + Q - 1 q-grams, so n characters within the budget keep at
#: least n - Q + 1 - LOST * n of them. Filter and verification use this one budget: the filter drops no region within it.
EDITS, RUNS = 0.20, 0.044
LOST = EDITS + RUNS * (Q - 1)
#: Half-overlapping diagonal bands are at least this wide, and wide enough for the edits of a stretch; hits farther apart than GAP, or whose diagonals
#: differ by more than DRIFT, start a new stretch.
BAND, GAP, DRIFT = 64, 60, 24
#: Bits of a q-gram's hash that are looked up before it is searched.
BITS = 22
#: Share of a passage that a stretch, and the two best stretches together, must cover.
STRETCH, SHARE = 0.12, 0.29
#: Characters of the shortest stretch.
SHORTEST = 40
_ODD = np.uint64(0x9E3779B97F4A7C15)


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Code point to its lower-case letter or digit, or to a blank; made once a process."""
    if not _TABLE:
        out = np.full(0x110000, 32, np.uint32)
        for k in range(0x32400):  # no letters are assigned beyond
            c = chr(k)
            if c.isalnum():
                low = c.lower()
                out[k] = ord(low) if len(low) == 1 else k
        _TABLE.append(out)
    return _TABLE[0]


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, starts): letters and digits of all texts in lower case with single blanks between words, one text after the
    other; text k is codes[starts[k]:starts[k + 1]]. Marks that wrap or quote lines, case and punctuation thus never cost an edit."""
    sizes = np.array([len(t) for t in texts], np.int64)
    code = _table()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    blank = code == 32
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
    keep = ~(blank & (first | np.r_[True, blank[:-1]])) if len(owner) else first
    code, owner = code[keep], owner[keep]
    if len(owner):  # what is left of blanks at the end of a text
        keep = ~((code == 32) & np.r_[owner[1:] != owner[:-1], True])
        code, owner = code[keep], owner[keep]
    return code, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].astype(np.int64)


def codes(text: str) -> np.ndarray:
    return encode([text])[0]


def grams(code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every q-gram: polynomial hashes of doubled lengths, then one mixing step."""
    if len(code) < Q:
        return np.empty(0, np.uint64)
    h, n, known = code.astype(np.uint64), 1, {}
    with np.errstate(over="ignore"):
        while True:
            known[n] = h
            if 2 * n > Q:
                break
            h = h[:-n] * _power(n) + h[n:]
            n *= 2
        for part in sorted(known, reverse=True)[1:]:  # Q in binary
            if n + part <= Q:
                rest = known[part][n:]
                h = h[: len(rest)] * _power(part) + rest
                n += part
        h = h * _ODD
        return (h ^ (h >> np.uint64(29))) * _ODD


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))


def passages(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item id, passage): the text of each item without the sentences that items of other text share (instructions and
    closing questions). An item without a sentence of its own has no row. Sentences are compared by a hash of their letters and digits."""
    key = lambda s: F.md5(F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))
    said = F.filter(F.split(item_text, r"(?<=[.?!:])\s+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    each = items.select(F.col(item_id).alias("_id"), F.transform(said, lambda s: F.struct(s.alias("s"), key(s).alias("k"))).alias("l"))
    rows = each.select("_id", F.md5(F.concat_ws("", F.transform("l", lambda x: x["k"]))).alias("t"), F.posexplode("l").alias("i", "x")).select("_id", "t", "i", "x.*")
    # items of equal text are not items that share: each distinct text counts once
    shared = rows.select("t", "k").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    own = rows.join(shared, "k", "left_anti").groupBy("_id", "t").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("l"))  # one item's text
    return own.select(F.col("_id").alias(item_id), F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("passage"))


@dataclass
class Index:
    ids: np.ndarray
    code: list[np.ndarray]
    length: np.ndarray
    need: np.ndarray
    least: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    seen: np.ndarray  # whether any q-gram has these upper bits


def _marks(gram: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[gram >> np.uint64(64 - BITS)] = True
    return out


def build(ids: list[int], texts: list[str]) -> Index:
    """Sorted q-grams of the passages with their places; ``need`` is the q-gram
    lemma's bound for one stretch of an item, ``least`` the one for all stretches together."""
    code = [codes(t) for t in texts]
    length = np.array([len(c) for c in code], np.int64)
    least = np.maximum(SHORTEST, (STRETCH * length).astype(np.int64))
    bound = np.maximum(1, least - Q + 1 - np.ceil(LOST * least).astype(np.int64))
    g = [grams(c) for c in code]
    gram = np.concatenate(g) if g else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(g)), [len(x) for x in g]) if g else np.empty(0, np.int64)
    pos = np.concatenate([np.arange(len(x)) for x in g]) if g else np.empty(0, np.int64)
    order = np.argsort(gram, kind="stable")
    whole = np.maximum(1, (SHARE * length * (1 - LOST)).astype(np.int64) - 2 * Q)
    return Index(np.array(ids), code, length, bound, whole, gram[order], item[order].astype(np.int32), pos[order].astype(np.int64), _marks(gram))


def _ramps(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, in a row."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def stretches(code: np.ndarray, starts: np.ndarray, index: Index) -> dict[str, np.ndarray]:
    """Regions of (document, item) that pass the filter: arrays doc, item, i0, i1, j0, j1."""
    all_grams = grams(code)
    place = np.flatnonzero(index.seen[all_grams >> np.uint64(64 - BITS)])
    owner = np.searchsorted(starts, place, "right") - 1
    own = place + Q <= starts[owner + 1]  # q-grams across two texts are none
    place, owner = place[own], owner[own]
    lo, hi = np.searchsorted(index.gram, all_grams[place], "left"), np.searchsorted(index.gram, all_grams[place], "right")
    n = hi - lo
    at = np.repeat((lo - np.cumsum(n) + n).astype(np.int32), n) + np.arange(int(n.sum()), dtype=np.int32)
    item = index.item[at]
    # the lemma on the whole pair first: too few shared q-grams in all for the covered share that is asked; places follow for the rest only
    pair = np.repeat(owner * len(index.ids), n) + item
    if (len(starts) - 1) * len(index.ids) <= 8 * len(pair):
        many = np.bincount(pair, minlength=(len(starts) - 1) * len(index.ids)).reshape(-1, len(index.ids)) >= index.least
        some = np.flatnonzero(many.ravel()[pair])
        number = (np.cumsum(many.ravel()) - 1)[pair[some]]
    else:
        ids, back, total = np.unique(pair, return_inverse=True, return_counts=True)
        many = total >= index.least[ids % len(index.ids)]
        some = np.flatnonzero(many[back])
        number = (np.cumsum(many) - 1)[back[some]]
    hit = np.repeat(np.arange(len(n), dtype=np.int32), n)[some]
    doc, j, item, i = owner[hit], (place - starts[owner])[hit], item[some].astype(np.int64), index.pos[at[some]]
    # each hit counts in two half-overlapping bands; passages start at offset `shift`, so diagonals are positive
    width = 2 * max(BAND // 2, int(np.ceil(EDITS * STRETCH * index.length.max(initial=0))))
    shift = int(index.length.max(initial=0)) + width
    diag = j - i + shift
    span = (int(diag.max(initial=0)) // (width // 2)) + 2
    key = number * span
    wide = int(index.length.max(initial=0)) + 1
    needed = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    needed[number] = index.need[item]
    keep = np.zeros(len(diag), bool)
    for half in (0, 1):
        band = key + (diag + half * (width // 2)) // width
        # hits bound places, so only bands with enough hits are counted by distinct places of the passage
        full = np.flatnonzero((np.bincount(band) if len(band) else band)[band] >= needed[number])
        places = np.sort(band[full] * wide + i[full])
        places = places[np.r_[True, places[1:] != places[:-1]]] if len(places) else places
        bands, count = np.unique(places // wide, return_counts=True)
        ok = bands[count >= needed[bands // span]]
        if len(ok):
            keep[full] |= ok[np.minimum(np.searchsorted(ok, band[full]), len(ok) - 1)] == band[full]
    doc, item, i, j = doc[keep], item[keep], i[keep], j[keep]
    if not len(doc):
        return {k: np.empty(0, np.int64) for k in ("doc", "item", "i0", "i1", "j0", "j1")}
    # hits of one alignment drift slowly across diagonals; a jump (as in repetitive passages) starts another
    order = np.lexsort((j, j - i, item, doc))
    doc, item, i, j = doc[order], item[order], i[order], j[order]
    track = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(j - i) > DRIFT)])
    order = np.lexsort((i, j, track))
    doc, item, i, j, track = doc[order], item[order], i[order], j[order], track[order]
    same = track[1:] == track[:-1]
    near = (np.abs(np.diff(j)) <= GAP) & (np.abs(np.diff(i)) <= GAP)
    start = np.flatnonzero(np.r_[True, ~(same & near)])
    return {
        "doc": doc[start], "item": item[start],
        "i0": np.minimum.reduceat(i, start), "i1": np.maximum.reduceat(i, start) + Q,
        "j0": np.minimum.reduceat(j, start), "j1": np.maximum.reduceat(j, start) + Q,
    }


def banded_distance(left: list[np.ndarray], right: list[np.ndarray], half: int) -> np.ndarray:
    """Edit distances of many pairs at once, restricted to ``half`` diagonals on either side of the main one.
    A pair that ends outside the band gets the length of its longer side."""
    n = len(left)
    if not n:
        return np.empty(0, np.int64)
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    width, rows = 2 * half + 1, int(la.max())
    a = np.zeros((n, rows), np.uint32)
    b = np.full((n, rows + width + 1), 0xFFFFFFFF, np.uint32)
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        a[k, : len(x)] = x
        y = y[: rows + half + 1]
        b[k, half : half + len(y)] = y
    big, ramp = 1 << 20, np.arange(width)
    d = np.where(ramp - half >= 0, ramp - half, big)[None, :].repeat(n, 0).astype(np.int32)
    ends = np.full(n, big, np.int64)
    for r in range(1, rows + 1):
        # column c of row r stands for position j = r + c - half of the right text
        swap = d + (b[:, r - 1 : r - 1 + width] != a[:, r - 1 : r])
        drop = np.concatenate([d[:, 1:], np.full((n, 1), big, np.int32)], 1) + 1
        best = np.minimum(swap, drop)
        best = np.where((r + ramp - half)[None, :] < 0, big, best)
        if r <= half:
            best[:, half - r] = r
        d = (np.minimum.accumulate(best - ramp, axis=1) + ramp).astype(np.int32)
        done = np.flatnonzero(la == r)
        if len(done):
            c = lb[done] - r + half
            inside = (c >= 0) & (c < width)
            ends[done[inside]] = d[done[inside], c[inside]]
    return np.where(ends < big, np.minimum(ends, np.maximum(la, lb)), np.maximum(la, lb))


def leaks(texts: list[str], index: Index, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, covered share) of the texts; the share is that of the two best verified stretches."""
    code, starts = encode(texts)
    s = stretches(code, starts, index)
    frame = pd.DataFrame(s)
    frame["size"] = frame.i1 - frame.i0
    frame = frame[frame["size"] >= SHORTEST // 2].sort_values(["doc", "item", "size"], ascending=[True, True, False])
    # verification only lowers the cover, so pairs whose two longest stretches fall short are done
    two = frame.groupby(["doc", "item"]).head(2).groupby(["doc", "item"])["size"].transform("sum").reindex(frame.index).ffill()
    frame = frame[two.to_numpy() >= share * index.length[frame["item"]]]
    s = {k: frame[k].to_numpy() for k in s}
    left = [index.code[t][a:b] for t, a, b in zip(s["item"], s["i0"], s["i1"], strict=True)]
    right = [code[starts[t] + a : starts[t] + b] for t, a, b in zip(s["doc"], s["j0"], s["j1"], strict=True)]
    size = s["i1"] - s["i0"]
    # a path of so many edits stays within as many diagonals; stretches of like length are aligned together
    cost = np.maximum(size, s["j1"] - s["j0"])
    budget = (EDITS * size).astype(np.int64)
    close = np.abs(s["j1"] - s["j0"] - size) <= budget
    klass = np.frexp(size.astype(float))[1]
    for k in np.unique(klass[close]):
        own = np.flatnonzero(close & (klass == k))
        cost[own] = banded_distance([left[x] for x in own], [right[x] for x in own], max(1, int(budget[own].max())))
    good = cost <= budget
    s = {k: v[good] for k, v in s.items()}
    frame = pd.DataFrame(s)
    if frame.empty:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    # stretches of one item that overlap count their places once: keep the longest, trim the others
    frame["size"] = frame.i1 - frame.i0
    frame = frame.sort_values(["doc", "item", "size", "i0"], ascending=[True, True, False, True])
    docs, items, shares = [], [], []
    for (doc, item), g in frame.groupby(["doc", "item"], sort=False):
        i0, i1 = g.i0.to_numpy(), g.i1.to_numpy()
        best = int(i1[0] - i0[0])
        extra = 0
        for a, b in zip(i0[1:], i1[1:], strict=True):
            extra = max(extra, int(b - a) - max(0, min(b, i1[0]) - max(a, i0[0])))
        docs.append(doc), items.append(item), shares.append((best + extra) / index.length[item])
    return np.array(docs), np.array(items), np.array(shares)


_BUILT: dict[str, Index] = {}


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block_mb: float = 4.0) -> DataFrame:
    """(doc id, item id, share): documents that carry at least ``share`` of an item's passage in one or two stretches.

    Whole texts are searched; documents are scanned without a shuffle, once for each block of about
    ``block_mb`` of passages. A block travels to the executors, where its index is built once a worker; the blocks
    together are all items. Null or empty texts leak nothing; items without a passage of their own (null, empty or
    shared sentences only) are never reported; items with equal text are all reported;
    repeated rows give repeated results.
    """
    spark = ship(docs.sparkSession)
    need(docs, [id_col, text_col])
    own = cut(passages(items, item_id, item_text))
    blocks = max(1, math.ceil((own.agg(F.sum(F.length("passage"))).first()[0] or 0) / (block_mb * 1e6)))
    scanned = widen(docs.select(id_col, text_col).where(f"length({text_col}) > 0"))
    kinds, own_kinds = dict(docs.dtypes), dict(items.dtypes)

    def block(k: int) -> DataFrame:
        rows = own.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == k).orderBy(item_id).collect()
        shipped, name = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows])), uuid.uuid4().hex

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if name not in _BUILT:  # workers are kept between tasks
                _BUILT.clear()
                _BUILT[name] = build(*shipped.value)
            index = _BUILT[name]
            for part in parts:
                for at in range(0, len(part) if len(index.gram) else 0, 512):
                    some = part.iloc[at : at + 512]
                    doc, item, got = leaks([t if isinstance(t, str) else "" for t in some[text_col]], index, share)
                    ok = got >= share
                    yield pd.DataFrame({id_col: some[id_col].to_numpy()[doc[ok]], item_id: index.ids[item[ok]], "share": got[ok]})

        return scanned.mapInPandas(run, f"{id_col} {kinds[id_col]}, {item_id} {own_kinds[item_id]}, share double")

    return functools.reduce(DataFrame.unionByName, [block(k) for k in range(blocks)])
