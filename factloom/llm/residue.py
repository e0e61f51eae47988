"""Template residue, filler and error pages: a regularised linear classifier on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.boilerplate import main_texts
from factloom.llm.stuffing import WORDS
from factloom.session import cut, ship, widen

#: Slots of the common template languages that no value has filled. Fixed values.
SLOT = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{0,60}%\}|<%=?[^<>\n]{0,60}%>|\$\{[^{}\n]{0,60}\}|\{#[^{}\n]{0,40}\}|\*\|[^|\n]{1,40}\|\*|##\w[\w ]{0,40}##|__[A-Za-z]\w{0,40}?__"
    r"|%[A-Za-z][A-Za-z_]{2,40}%|@[Mm][Oo][Dd][Ee][Ll]\.[\w.]{1,40}|@@\w{2,40}@@|\[\[[\w .:-]{1,40}\]\]|\[object object\]"
    r"|\[(?:insert|your|enter|add)\b[^\[\]\n]{0,40}\]|\[(?:first|last|full|product|brand|store|city|customer|user|company|shop|order|offer|price|qty|quantity|date|name|title|headline|id|item)(?:[ _](?:name|id|no|number|date))?\]",
    re.I,
)
#: Empty values where a value belongs, written as words.
_VOID = re.compile(r"(?<![\w'’-])(?:NaN|undefined|null)(?![\w'’-])")
#: A slot right behind one of these words is spoken of, not left open: "the software prints {{price}} when ...".
_SPOKEN = re.compile(r"\b(?:prints?|printed|shows?|displays?|outputs?|renders?|writes?|says?|reads?|types?|syntax|placeholders?|variables?|fields?|tokens?)\s+$", re.I)
#: Words between quotes are talk about them, as in: the letter that began with "Dear [First Name]".
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»\n]{0,200}[\"”“»]|(?<!\w)[‘'`][^‘’'`\n]{0,120}[’'`](?!\w)|`[^`\n]{1,120}`")
#: Phrases of error messages, demands for scripts and filler, for weak labels only. Fixed values.
PHRASES = re.compile(
    r"page not found|not be found|nicht gefunden|no se ha encontrado|introuvable|non trovata|access denied|acceso denegado|forbidden|bad gateway|internal server error|service (?:is )?(?:down|unavailable)"
    r"|timed out|too many requests|something went wrong|session has expired|unhandled exception|error (?:code )?\d{3}|javascript (?:is|must|muss)|(?:enable|activate|allow|aktivieren sie|activa|turn on|needs|without) (?:javascript|scripts?|scripting|js)\b|browser (?:is (?:too old|not supported)|blocks)|(?:scripts?|scripting|js|javascript) (?:is |are )?(?:turned off|disabled|required|switched)|are you a (?:robot|human)|unusual traffic"
    r"|lorem ipsum|placeholder|coming soon|your text goes here|sample (?:headline|text)|insert \w+ \w+|text text text|asdf|xxxx+|todo:|to follow\.",
    re.I,
)
_WORD = re.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?|\d+|[^\w\s]")
_STOP = re.compile(r"(?<=[.!?…।])\s+|\n+")
_TOKEN = re.compile(r"[\p{L}\p{M}]+")
_FUNCTION = frozenset().union(*WORDS.values())
BITS, WORD_BITS, SLOT_MARKS = 16, 20, 8
#: A sentence whose slot the exact check finds open needs this little from the classifier.
SLOT_SURE = 0.1


def pieces(text: str) -> list[str]:
    return [s for s in _STOP.split(text) if s.strip()]


def open_slots(text: str) -> bool:
    """Whether a text has an unfilled slot outside quotes."""
    if not _SLOT_START.search(text):
        return False
    plain = _QUOTED.sub(" ", text)
    return any(not _SPOKEN.search(plain[max(0, m.start() - 20) : m.start()]) for m in SLOT.finditer(plain))


def word_bits(text: Column) -> Column:
    """Hashes of the distinct words of a text, of WORD_BITS bits, as word_bit gives them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}]+)"), 1))
    return F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(1 << WORD_BITS)).cast("int"))


def word_bit(word: str) -> int:
    return crc32(word.encode()) & ((1 << WORD_BITS) - 1)


def vocabulary(pages: DataFrame, share: float = 0.004, least: int = 3) -> np.ndarray:
    """Bits of the words found in at least this share of the different texts of all pages (and in ``least`` of them).

    Equal texts count once: texts are reduced to the hashes of their words, gathered by a hash of the text, and counted by
    word. The result has at most 2**WORD_BITS entries, whatever the number of pages."""
    texts = pages.where("length(trim(text)) > 0").select(F.xxhash64("text").alias("t"), word_bits(F.col("text")).alias("w"))
    texts = cut(texts.groupBy("t").agg(F.first("w").alias("w")))
    floor = max(least, share * texts.count())
    known = np.zeros(1 << WORD_BITS, bool)
    common = texts.select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor).select("w")
    known[[r[0] for r in common.collect()]] = True
    return known


def strangeness(text: str, known: np.ndarray) -> float:
    """Share of the words that are neither function words of any language nor common among the pages."""
    words = _TOKEN.findall(text.lower())
    if len(words) < 5:
        return 0.0
    return sum(w not in _FUNCTION and not known[word_bit(w)] for w in words) / len(words)


@dataclass
class Sentences:
    """Sentences of many texts as features: for each its text, length, and marks; and the (sentence, feature) entries of all."""

    text: np.ndarray
    size: np.ndarray
    slot: np.ndarray  # an unfilled slot outside quotes
    void: np.ndarray  # an empty value written as a word, outside quotes
    owner: np.ndarray
    feature: np.ndarray


_SLOT_START, _VOID_START, _QUOTE = re.compile(r"[{%<$#*_@\[]"), re.compile("NaN|undefined|null", re.I), re.compile(r"[\"“„«‘'`]")


def _hash(a: np.ndarray, salt: int) -> np.ndarray:
    h = (a.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


def sentences(texts: Sequence[str], titles: Sequence[bool], known: np.ndarray, memo: dict[str, tuple[int, int]] | None = None) -> Sentences:
    """Hashed word 1- to 3-grams of every sentence, with marks for its length, the page's length, its title and strange words.

    Every sentence is tokenised once; n-grams are made and hashed for all sentences together. ``memo`` keeps the
    (hash, strange) of words between calls."""
    memo = {} if memo is None else memo
    text, size, slot, void, counts, flat, odd = [], [], [], [], [], [], []
    for k, whole in enumerate(texts):
        for piece in pieces(whole):
            plain = _QUOTED.sub(' " " ', piece) if _QUOTE.search(piece) else piece
            slots = bool(_SLOT_START.search(plain)) and open_slots(piece)
            if _SLOT_START.search(plain):
                plain = SLOT.sub(" ⟨slot⟩ ", plain)
            voids = bool(_VOID_START.search(plain)) and bool(_VOID.search(plain))
            if voids:
                plain = _VOID.sub(" ⟨void⟩ ", plain)
            words = _WORD.findall(plain.lower())
            for w in words:
                if w not in memo:
                    name = "⟨slot⟩" if w == "slot" else "#" if w.isdigit() else w
                    parts = _TOKEN.findall(w)
                    memo[w] = crc32(name.encode()), sum(x not in _FUNCTION and not known[word_bit(x)] for x in parts) * 256 + len(parts)
            got = [memo[w] for w in words]
            strange = sum(x[1] for x in got)
            text.append(k), size.append(len(piece)), slot.append(slots), void.append(voids), counts.append(len(words))
            flat += [x[0] for x in got]
            odd.append(int(4 * (strange // 256) / (strange % 256)) if 5 <= strange % 256 else -1)
    n = np.array(counts, np.int64)
    word, own = np.array(flat, np.uint64), np.repeat(np.arange(len(n)), n)
    marks, at = np.arange(len(n)), np.array(text, np.int64)
    bits = np.array([min(10, len(t).bit_length()) for t in texts], np.int64)
    pair = own[1:] == own[:-1]
    two = _hash(word[:-1], 1) ^ _hash(word[1:], 2)
    triple = pair[1:] & pair[:-1]
    three = two[:-1] ^ _hash(word[2:], 3)
    head = np.array(titles, np.int64)[at] if len(at) else at
    extra = [_hash(np.minimum(8, n // 4), 11), _hash(bits[at] if len(at) else at, 12), _hash(head, 13), _hash(np.array(odd, np.int64) + 1, 14)]
    # one slot among sixty words must be able to decide, so its mark counts as SLOT_MARKS features
    slotted = np.flatnonzero(np.array(slot, bool) | np.array(void, bool))
    extra += [_hash(np.full(len(slotted), 15 + k), 15) for k in range(SLOT_MARKS)]
    owner = np.concatenate([own, own[1:][pair], own[2:][triple], *[marks] * 4, *[slotted] * SLOT_MARKS])
    code = np.concatenate([_hash(word, 0), _hash(two[pair], 4), _hash(three[triple], 5), *extra]) & np.uint64((1 << BITS) - 1)
    key = np.sort((owner.astype(np.uint64) << np.uint64(BITS)) | code)  # a feature counts once a sentence
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    if len(memo) > 500_000:
        memo.clear()
    return Sentences(at, np.array(size, np.int64), np.array(slot, bool), np.array(void, bool), (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64))


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    known: np.ndarray
    held_out: dict[str, float]

    def score(self, got: Sentences) -> np.ndarray:
        n = len(got.size)
        z = np.bincount(got.owner, self.weight[got.feature], n) / np.sqrt(np.maximum(np.bincount(got.owner, minlength=n), 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(got: Sentences, labels: np.ndarray, weights: np.ndarray, l2: float = 1e-4, epochs: int = 40) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by full-batch Adam; rows are scaled to unit length. Rows of weight 0 take no part."""
    part = (weights > 0)[got.owner]
    flat, owner, n = got.feature[part], got.owner[part], len(labels)
    scale = (1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1)))[owner]
    w, b = np.zeros(1 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    total, rows = weights.sum(), max(1, int((weights > 0).sum()))
    for t in range(1, epochs + 1):
        z = np.bincount(owner, w[flat] * scale, n) + b
        error = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / total
        g = np.bincount(flat, (error[owner] * scale), 1 << BITS) + l2 * w / rows**0.5
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.3 / (1 + t / 60)
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def weak_label(text: str, status: int | None, title: bool, known: np.ndarray) -> float | None:
    """1 for a page that phrases or its status mark as residue, 0 for one that both mark as real, None if unsure."""
    if not text.strip():
        return None
    body = pieces(text)
    plain = _QUOTED.sub(" ", text)
    said, slots = bool(PHRASES.search(plain)), open_slots(text)
    marked = sum(len(p) for p in body if PHRASES.search(_QUOTED.sub(" ", p)) or open_slots(p)) if said or slots else 0
    size = sum(map(len, body))
    if marked > 0.3 * size and size < 1200:
        return 1.0
    if len(text) > 100 and strangeness(text, known) > 0.6:
        return 1.0
    if status is not None and status >= 400 and size < 120 and not title:
        return 1.0
    if (size >= 300 or (title and size >= 60)) and not said and not slots and (status or 200) < 400:
        return 0.0
    return None


def train(sample: list[tuple[str, str, int | None, bool]], known: np.ndarray, max_sentences: int = 20_000) -> Model:
    """A model from (site, text, status, title) rows. Sites of one in five (by hash) are held out and measured; the
    final weights use all rows.

    A sentence with an open slot is residue; any other has the label of its page, but is left out where the page is
    residue for its slots, or unsure. At most ``max_sentences`` sentences of each label are used, chosen by a hash."""
    held: dict[str, float] = {}
    marked = [(site, text, title, y) for site, text, status, title in sample if (y := weak_label(text, status, title, known)) is not None or open_slots(text)]
    if not any(y == 1.0 for *_, y in marked) or not any(y == 0.0 for *_, y in marked):
        return Model(np.zeros(1 << BITS), -9.0, known, held)
    got = sentences([t for _, t, _, _ in marked], [bool(h) for _, _, h, _ in marked], known)
    page = np.array([np.nan if y is None else y for *_, y in marked])
    slots = np.bincount(got.text, got.slot, len(page)) > 0
    labels = np.where(got.slot, 1.0, np.where(slots & (page != 0), np.nan, page)[got.text])
    draw = _hash(np.arange(len(labels)), 21)
    for y in (0.0, 1.0):
        own = np.flatnonzero(labels == y)
        labels[own[np.argsort(draw[own])][max_sentences:]] = np.nan
    apart = np.array([crc32((site or "").encode()) % 5 == 0 for site, *_ in marked])

    def weights(pages: np.ndarray) -> np.ndarray:
        use = pages[got.text] & ~np.isnan(labels)
        return np.where(use, np.where(labels > 0, 0.5 / max(1, (use & (labels > 0)).sum()), 0.5 / max(1, (use & (labels == 0)).sum())), 0.0)

    target = np.nan_to_num(labels)
    if apart.any() and {0.0, 1.0} <= set(page[~apart]):
        w, b = fit(got, target, weights(~apart))
        cover, slot = residue_shares(got, len(marked), Model(w, b, known, held))
        sure = apart & ~np.isnan(page)
        says, true = ((cover > 0.5) | slot)[sure], page[sure] > 0.5
        held = {"pages": float(sure.sum()), "accuracy": float((says == true).mean()), "recall": float(says[true].mean()) if true.any() else 1.0, "precision": float(true[says].mean()) if says.any() else 1.0}
    w, b = fit(got, target, weights(np.ones(len(marked), bool)))
    return Model(w, b, known, held)


def residue_shares(got: Sentences, n: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts: the share of its characters in sentences scored as residue, and whether such a sentence has an open slot or an empty value."""
    p = model.score(got)
    bad, slot = p > 0.5, (p > SLOT_SURE) & got.slot | (p > 0.5) & got.void
    size = np.bincount(got.text, got.size, n)
    cover = np.bincount(got.text, got.size * bad, n) / np.maximum(size, 1)
    return cover, np.bincount(got.text, slot, n) > 0


def fit_residue(bodies: DataFrame, max_sample: int = 5000) -> tuple[DataFrame, Model]:
    """The main texts of all bodies, and the model fitted on at most about ``max_sample`` of them, chosen by a hash of the id."""
    ship(bodies.sparkSession)
    pages = cut(main_texts(bodies))
    n = pages.count()
    known = vocabulary(pages)
    picked = pages.where(F.pmod(F.xxhash64(F.lit("residue"), "body_id"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, max_sample / max(1, n))))
    rows = picked.select("site", "text", "http_status", "title").limit(2 * max_sample).collect()
    return pages, train([tuple(r) for r in rows], known)


def find_residue(bodies: DataFrame, max_sample: int = 5000, share: float = 0.5) -> DataFrame:
    """(body_id, residue, slot): bodies whose main text is an error message, a demand for scripts or filler, or has open slots.

    Main texts come from the induction of site templates, so notices among the
    furniture do not count. The classifier is fitted on at most about ``max_sample`` bodies, chosen by a hash of
    the id, with labels from response status and phrases; its table of common words covers all bodies. Every body is
    scored, sentence by sentence, over its whole text. A slot counts where the classifier finds its sentence to be residue and an
    exact check finds it open. Null, empty and furniture-only texts are no cases; repeated rows give repeated results.
    """
    pages, model = fit_residue(bodies, max_sample)
    shipped = bodies.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, memo = shipped.value, {}
        for part in parts:
            for at in range(0, len(part), 2000):
                some = part.iloc[at : at + 2000]
                cover, slot = residue_shares(sentences(some["text"].tolist(), some["title"].fillna(False).astype(bool).tolist(), model.known, memo), len(some), model)
                out = pd.DataFrame({"body_id": some["body_id"].to_numpy(), "residue": cover, "slot": slot})
                yield out[(out["residue"] > share) | out["slot"]]

    return widen(pages.select("body_id", "title", "text")).mapInPandas(run, f"body_id {dict(bodies.dtypes)['body_id']}, residue double, slot boolean")


def validation(bodies: DataFrame, max_sample: int = 5000) -> DataFrame:
    """(metric, value): how the classifier does on the weak labels of sites that it was not fitted on."""
    held = fit_residue(bodies, max_sample)[1].held_out
    return bodies.sparkSession.createDataFrame(sorted(held.items()), "metric string, value double")
