"""Languages of documents and of their segments by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams in order. A clause is
assigned to the profile with the least out-of-place distance; a unit of text gets every
language in which at least a clause of it is written.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import need, ship, widen

#: ISO 639-1 code, ISO 639-2 and -3 codes, English and native name.
LANGUAGES = (
    "ar ara arabic العربية", "bn ben bengali বাংলা", "cs ces cze czech čeština", "da dan danish dansk", "de deu ger german deutsch",
    "el ell gre greek ελληνικά", "en eng english", "es spa spanish español castellano", "fa fas per persian farsi", "fi fin finnish suomi",
    "fr fra fre french français", "gu guj gujarati", "he heb hebrew", "hi hin hindi हिन्दी हिंदी", "hu hun hungarian magyar",
    "id ind indonesian bahasa", "it ita italian italiano", "ja jpn japanese 日本語", "ko kor korean 한국어", "mr mar marathi मराठी",
    "nl nld dut dutch nederlands", "no nor nob norwegian norsk", "pl pol polish polski", "pt por portuguese português",
    "ro ron rum romanian română", "ru rus russian русский", "sv swe swedish svenska", "ta tam tamil தமிழ்", "te tel telugu",
    "th tha thai ไทย", "tr tur turkish türkçe", "uk ukr ukrainian українська", "ur urd urdu اردو", "vi vie vietnamese", "zh zho chi chinese 中文",
)
_NAMES = {name: row.split()[0] for row in LANGUAGES for name in row.split()}

#: Seeds for languages whose labelled sample is too small: article 1 of the Universal Declaration of
#: Human Rights and a few everyday words. Fixed values.
SEEDS = {
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood this is what the people of my house want to buy because it is good and not too much for them when you are there but i would not have it",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros esto es lo que la gente de mi casa quiere comprar porque es bueno y no es demasiado para ellos cuando estás allí pero yo no lo compraría",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité c'est ce que les gens de ma maison veulent acheter parce que c'est bon et pas trop pour eux quand on est là mais je ne le prendrais pas",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geiste der brüderlichkeit begegnen das ist es was die leute in meinem haus kaufen wollen weil es gut ist und nicht zu viel für sie wenn man dort ist aber ich würde es nicht nehmen",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza questo è quello che la gente della mia casa vuole comprare perché è buono e non è troppo per loro quando sei lì ma non lo prenderei",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razão e de consciência devem agir uns para com os outros em espírito de fraternidade isto é o que as pessoas da minha casa querem comprar porque é bom e não é demais para eles quando você está lá mas eu não compraria",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen dit is wat de mensen in mijn huis willen kopen omdat het goed is en niet te veel voor hen als je daar bent maar ik zou het niet nemen",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए यह मेरे घर के लोगों के लिए अच्छा है लेकिन मैं इसे नहीं लूँगा क्योंकि बहुत है",
    "hi-latn": "sabhi manushyon ko gaurav aur adhikaron ke mamle mein janmajat svatantrata aur samanta prapt hai unhen buddhi aur antaratma ki den prapt hai aur paraspar unhen bhaichare ke bhav se bartav karna chahiye yeh mere ghar ke logon ke liye achha hai lekin main ise nahin lunga kyonki bahut hai",
}

ORDERS, SIZE, MIN_WORDS = (1, 2, 3, 4), 600, 3
_TAG = re.compile(r"(?:https?://|www\.)\S+|[#@][\w\p{M}\-]+")
_ACCENT = re.compile("[\u0300-\u036f]+")
_NOT_WORD = re.compile(r"[^\p{L}\p{M}\s'’\-]")
_BREAK = re.compile(r"[.!?;:,…।॥|()\[\]{}\"“”«»\n\r\t–—/]+|[^\w\p{M}\s'’\-]")
#: A clause of at least LONG words is also read in halves: two languages may follow each other without a mark.
LONG, SURE = 12, 0.9
MEMO = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def label_code(label: str | None) -> str | None:
    """Two-letter code that a language label names, in any notation; None if it names none."""
    if not label:
        return None
    bare = label.strip().lower()
    if bare in _NAMES:
        return _NAMES[bare]
    head = re.split(r"[-_\s(]", bare)[0]
    return _NAMES.get(head)


def code_of(label: Column) -> Column:
    """label_code as an expression."""
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    bare = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(names, bare), F.try_element_at(names, F.regexp_extract(bare, r"(?U)^[^-_\s(]*", 0)))


def fold(text: str) -> str:
    """Lower case without the accents of Latin letters; other scripts keep their marks."""
    low = text.lower()
    return low if low.isascii() else _ACCENT.sub("", unicodedata.normalize("NFD", low))


def clauses(unit: str, skip: frozenset[str] = frozenset()) -> list[str]:
    """Clauses of a unit as folded words: split at punctuation and signs, without tags, addresses and
    digits, and without the words to ``skip``. Pieces of fewer than MIN_WORDS words join the piece behind them, else the one before."""
    pieces = []
    for piece in _BREAK.split(fold(_TAG.sub(" ", unit))):
        words = [w for w in _NOT_WORD.sub(" ", piece).replace("’", "'").split() if (w[0].isalpha() or any(c.isalpha() for c in w)) and w not in skip]
        if words:
            pieces.append(words)
    out: list[list[str]] = []
    carry: list[str] = []
    for words in pieces:
        words = carry + words
        carry = []
        if len(words) < MIN_WORDS:
            carry = words
        else:
            out.append(words)
    if carry and out:
        out[-1] = out[-1] + carry
    return [" ".join(w) for w in out]


def is_latin(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return sum("a" <= c <= "z" for c in letters) * 2 >= len(letters)


def _grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every n-gram of every word; a blank marks both ends of a word."""
    padded = [" " + t + " " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    blank = code == 32
    segs, hashes = [], []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = owner[:m] == owner[n - 1 :]
        ok &= ~blank[:m] if n == 1 else True
        for k in range(1, n - 1):
            ok &= ~blank[k : k + m]
        if n == 2:
            ok &= ~(blank[:m] & blank[1:])
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h + code[k : k + m]) * _ODD
            h ^= h >> np.uint64(31)
        segs.append(owner[:m][ok])
        hashes.append(h[ok])
    return np.concatenate(segs), np.concatenate(hashes)


def _ranked(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, rank) of the distinct n-grams of each text, by falling frequency; at most 2**12 texts.

    Text number, count and hash are packed into one sort key, so the hash keeps its upper 52 bits."""
    seg, h = _grams(texts)
    key = np.sort((seg.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.r_[start, len(key)])
    seg, h = (key[start] >> np.uint64(52)).astype(np.int64), key[start] & np.uint64((1 << 52) - 1)
    # falling counts inside a text; the sort is stable, so ties stay in order of their hash
    most = int(count.max(initial=1))
    order = np.argsort(seg * (most + 1) + (most - count), kind="stable")
    seg, h = seg[order], h[order]
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.empty(0, np.int64)
    rank = np.arange(len(seg)) - np.repeat(first, np.diff(np.r_[first, len(seg)]))
    return seg, h, rank


@dataclass
class Profiles:
    names: list[str]  # language, with '-latn' for a second script
    gram: np.ndarray  # sorted hashes
    rank: np.ndarray  # gram x language, SIZE where a language lacks the n-gram
    shared: frozenset[str] = frozenset()  # words that most languages use alike: names of products and brands

    def distances(self, texts: Sequence[str], chunk: int = 1000) -> np.ndarray:
        """Mean out-of-place distance of each text to each profile, from 0 to 1."""
        out = np.ones((len(texts), len(self.names)))
        for at in range(0, len(texts), chunk):
            seg, h, rank = _ranked(texts[at : at + chunk])
            if not len(seg):
                continue
            place = np.minimum(np.searchsorted(self.gram, h), len(self.gram) - 1)
            known = np.flatnonzero(self.gram[place] == h)
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            size = np.bincount(seg[first], np.diff(np.r_[first, len(seg)]), len(texts[at : at + chunk]))
            # n-grams in no profile are SIZE apart from every language; the others are looked up
            ranks = self.rank[place[known]]
            apart = np.abs(ranks - rank[known, None].clip(max=SIZE - 1).astype(np.int32))
            apart[ranks == SIZE] = SIZE
            owner = seg[known]
            near = np.stack([np.bincount(owner, SIZE - apart[:, k], len(size)) for k in range(len(self.names))], 1)
            some = size > 0
            out[at : at + chunk][some] = 1 - near[some] / (size[some, None] * SIZE)
        return out

    def classify(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(profile number, confidence) of each text; the confidence is a logistic of the lead over the
        best profile of another language."""
        d = self.distances(texts)
        best = d.argmin(1)
        lang = np.array([n.split("-")[0] for n in self.names])
        rival = np.where(lang[None, :] == lang[best][:, None], 9.0, d).min(1) if len(set(lang)) > 1 else np.full(len(d), 1.0)
        lead = rival - d[np.arange(len(d)), best]
        return best, np.where(d.min(1) >= 1.0, 0.0, 1 / (1 + np.exp(-60 * lead)))


def shared_words(texts: dict[str, Iterable[str]]) -> frozenset[str]:
    """Words found in the texts of more than half of the languages of a script (of at least four): borrowed names."""
    seen: Counter[str] = Counter()
    latin = [n for n, cs in texts.items() if is_latin(" ".join(list(cs)[:20]))]
    for n in latin:
        seen.update({w for w, k in Counter(w for c in texts[n] for w in c.split()).items() if k > 1})
    return frozenset(w for w, n in seen.items() if n > max(3, len(latin) / 2))


def build(texts: dict[str, Iterable[str]]) -> Profiles:
    """Profiles of the SIZE most frequent n-grams of each language's texts."""
    names, columns = sorted(texts), []
    for name in names:
        joined = " ".join(texts[name])
        _, h, rank = _ranked([joined])
        columns.append((h[:SIZE], rank[:SIZE]))
    gram = np.unique(np.concatenate([h for h, _ in columns]))
    table = np.full((len(gram), len(names)), SIZE, np.int32)
    for k, (h, rank) in enumerate(columns):
        table[np.searchsorted(gram, h), k] = rank
    return Profiles(names, gram, table)


def learn(labelled: Iterable[tuple[str, str]], rounds: int = 2, least: int = 40) -> Profiles:
    """Profiles from (language, unit) pairs with noisy labels.

    Clauses are grouped by label and script. Each round drops the clauses that the
    profiles of the round before assign to another language, so wrong labels and mixed
    texts fade out. A group with fewer than ``least`` clauses is left to its seed.
    """
    groups: dict[str, list[str]] = defaultdict(list)
    seed_latin = {n.split("-")[0] for n in SEEDS if "-" not in n and is_latin(SEEDS[n])}
    for code, unit in labelled:
        for c in clauses(unit):
            groups[code if not is_latin(c) or code in seed_latin or code not in {n.split("-")[0] for n in SEEDS} else f"{code}-latn"].append(c)
    profiles = build({n: [fold(t)] for n, t in SEEDS.items()})
    for turn in range(rounds + 1):
        texts: dict[str, list[str]] = {n: [fold(t)] for n, t in SEEDS.items()}
        for name, cs in groups.items():
            if len(cs) < least:
                continue
            if name in profiles.names:
                best, _ = profiles.classify(cs)
                cs = [c for c, b in zip(cs, best, strict=True) if profiles.names[b] == name]
            elif turn == 0:
                cs = list(cs)
            if len(cs) >= least:
                texts[name] = cs
        profiles = build(texts)
    common = shared_words(texts)
    bare = {n: [t for c in cs if (t := " ".join(w for w in c.split() if w not in common))] for n, cs in texts.items()}
    profiles = build(bare)
    profiles.shared = common
    return profiles


def train_profiles(videos: DataFrame, fields: Sequence[str], id_col: str = "link_id", label_col: str = "lang", max_rows: int = 400) -> Profiles:
    """Profiles from a sample of labelled rows.

    The sample is bounded: about ``max_rows`` rows of each language label, chosen by a hash of the
    id, so it is the same at every run and needs no sort. Everything else the operator does covers all rows.
    """
    code = code_of(F.col(label_col))
    # one row per language of the table of names, however many spellings
    sizes = {r[0]: r["count"] for r in videos.groupBy(code.alias("c")).count().where("c is not null").collect()}
    if not sizes:
        return learn([])
    share = F.create_map(*[x for name, n in sorted(sizes.items()) for x in (F.lit(name), F.lit(min(1.0, max_rows / n)))])
    picked = videos.where(F.pmod(F.xxhash64(F.lit("profiles"), F.col(id_col)), F.lit(1_000_000)) < F.try_element_at(share, code) * 1_000_000)
    rows = picked.select(label_col, *fields).limit(2 * max_rows * len(sizes)).collect()
    pairs = []
    for row in rows:
        code = label_code(row[0])
        for value in row[1:]:
            for unit in (value.split("\n") if isinstance(value, str) else value or []):
                if code and unit:
                    pairs.append((code, unit))
    return learn(pairs)


def unit_languages(units: Sequence[str], profiles: Profiles, least: float = 0.55, seen: dict[str, tuple[str, float]] | None = None) -> list[dict[str, tuple[float, str]]]:
    """For each unit {language: (confidence, text of its clauses)}; {} without a clause of words. ``seen`` keeps the
    answers for clauses between calls, at most about MEMO of them."""
    parts = [clauses(u, profiles.shared) for u in units]
    flat = [c for p in parts for c in p]
    out: list[dict[str, tuple[float, str]]] = []
    if not flat:
        return [{} for _ in units]
    lang = [n.split("-")[0] for n in profiles.names]
    seen = {} if seen is None else seen

    def read(texts: Iterable[str]) -> None:
        """Classify what was not read before: stock phrases and repeated texts cost once."""
        new = [t for t in dict.fromkeys(texts) if t not in seen]
        best, sure = profiles.classify(new) if new else ((), ())
        seen.update((t, (lang[k], float(q))) for t, k, q in zip(new, best, sure, strict=True))

    def split(text: str) -> tuple[str, str]:
        words = text.split()
        return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])

    read(flat)
    halves = {c: split(c) for c in dict.fromkeys(flat) if c.count(" ") + 1 >= LONG}
    read(h for pair in halves.values() for h in pair)
    two = {}
    for c, pair in halves.items():
        (x, p), (y, q) = seen[pair[0]], seen[pair[1]]
        if x != y and min(p, q) > SURE:
            two[c] = [(x, p, pair[0]), (y, q, pair[1])]
    for p in parts:
        got: dict[str, list[tuple[float, str]]] = defaultdict(list)
        for c in p:
            for name, conf, text in two.get(c) or [(*seen[c], c)]:
                got[name].append((conf, text))
        kept = {k: (max(x[0] for x in v), " ".join(x[1] for x in v)) for k, v in got.items()}
        if len(kept) > 1:  # a second language needs a clause that is sure
            kept = {k: v for k, v in kept.items() if v[0] >= least} or kept
        out.append(kept)
    if len(seen) > MEMO:
        seen.clear()
    return out


def segment_languages(df: DataFrame, profiles: Profiles, id_col: str, fields: Sequence[str], label_col: str | None = None, whole: Sequence[str] = ()) -> DataFrame:
    """(id, field_name, seg_no, lang, confidence, label_lang, words) for each unit and language in it.

    Units are the lines of a text field, numbered from 1, and the elements of an array
    field; a text field named in ``whole`` is one unit. Null and
    empty units, and units without a clause of words, give no row. Repeated
    rows give repeated results. One pass without a shuffle; only the profiles travel.
    """
    need(df, [id_col, *fields])
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    shipped = df.sparkSession.sparkContext.broadcast(profiles)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = shipped.value, {}
        for part in parts:
            ids, names, numbers, labels, units = [], [], [], [], []
            marks = part["_label"] if "_label" in part else [None] * len(part)
            for f in fields:
                for key, label, value in zip(part[id_col], marks, part[f], strict=True):
                    if value is None or isinstance(value, float):
                        continue
                    pieces = [value] if f in whole else value.split("\n") if isinstance(value, str) else value
                    for k, unit in enumerate(pieces, 1):
                        if unit:
                            ids.append(key), names.append(f), numbers.append(k), labels.append(label), units.append(unit)
            found = unit_languages(units, own, seen=seen)
            rows = [(i, n, k, lang, conf, label_code(lab), text.count(" ") + 1) for i, n, k, lab, got in zip(ids, names, numbers, labels, found, strict=True) for lang, (conf, text) in got.items()]
            yield pd.DataFrame(rows, columns=[id_col, "field_name", "seg_no", "lang", "confidence", "label_lang", "words"])

    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    schema = f"{id_col} {kinds[id_col]}, field_name string, seg_no int, lang string, confidence double, label_lang string, words int"
    return widen(df.select(id_col, *fields, label.alias("_label"))).mapInPandas(run, schema)


def document_languages(segments: DataFrame, id_col: str) -> DataFrame:
    """(id, lang, confidence, share, n_langs) of each document with a clause of words: the language of most of its words.

    ``confidence`` is the mean of the units in that language, weighted by words, and ``share`` its part of all words.
    Ties go to the earlier code. Languages of a document are few, so both aggregates combine before they shuffle."""
    per = segments.groupBy(id_col, "lang").agg(F.sum("words").alias("n"), F.sum(F.col("confidence") * F.col("words")).alias("c"))
    top = F.max_by(F.struct("lang", "n", "c"), F.struct("n", F.negative(F.ascii(F.substring("lang", 1, 1)) * 256 + F.ascii(F.substring("lang", 2, 1)))))
    whole = per.groupBy(id_col).agg(top.alias("t"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("n_langs"))
    return whole.select(id_col, "t.lang", F.round(F.col("t.c") / F.col("t.n"), 6).alias("confidence"), F.round(F.col("t.n") / F.col("all"), 6).alias("share"), "n_langs")
