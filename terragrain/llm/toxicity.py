"""Toxicity scores of deobfuscated text by a noisy channel.

1. *Character language model.*  Trigram counts over the letters of all
   documents, those beyond Latin-1 as shared symbols; each task packs its counts, and packs are added up in a tree,
   so what reaches the driver is bounded by the alphabet, not by the corpus.
2. *Decoding.*  A suspect is a run of letters with digits or signs between
   them, of single letters parted by spaces or marks, or with a letter three
   times or more in a row; array operations over each whole text find the
   places where one may be.  Each of its signs spans a lattice column: letters
   stand for themselves, leetspeak signs for the letters they imitate,
   separators for nothing, and a repeated letter for itself or for nothing.
   Viterbi search finds the most likely path under channel costs and the
   language model.  Where marks or blanks part a suspect, it is read in more
   ways: each disguised piece between them, or between those of one kind, by
   itself, letters by themselves as one word, and the whole with separators
   that may end a word.  Long places are searched in windows that overlap by
   half and are read like short ones, so the time is linear in their length.
   Decoded words are read beside the text as it stands.
3. *Scoring.*  From a bounded sample of labelled texts, restored like any
   other, candidate words and word beginnings are ranked by how much more of
   the toxic texts than of the others hold them.  Terms are then taken
   greedily while each explains further toxic texts, so copies of one text
   or the words around a term add nothing; words that no other text holds
   and an ``often`` share of the toxic ones do are added.  Near copies of one
   label, by sketches of their five-word shingles, count once in the sample.  The score is
   the smoothed share of toxic texts among sample texts with the most telling
   term found.

Defined results: null and empty texts hold no term; they get the share of
toxic texts among sample texts without a term, like any clean text; with
nothing to learn from every score is 0.  A null doc_id falls in the fold of
the empty text.  Repeated rows are learned from once and scored each; equal
gains go to the term that sorts first; very long texts are read whole; an empty
table gives an empty result.  Kept columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import bounded_sample
from .session import carried, checkpointed
from .session import restored as named
from .textnp import Words, blocks, mix, shingles, string_buffer

#: Letters, and marks that belong to them, in lower case; 0: no letter.  All scripts lie below the table's end.
_LOWER = np.zeros(0x33480, dtype=np.uint32)
for _c in range(len(_LOWER) - 1):
    _l = chr(_c).lower()
    if _l[0].isalpha() or (_c > 0xFF and category(chr(_c))[0] == "M"):
        _LOWER[_c] = ord(_l[0])
#: Symbols of the character model: Latin-1 letters are their own, others share the numbers these leave free, so consecutive letters of a script differ.
_LATIN = np.unique(_LOWER[:0x100][_LOWER[:0x100] < 0x100])
_FREE = np.setdiff1d(np.arange(1, 256), _LATIN).astype(np.uint8)
_SYMBOL = _FREE[np.arange(len(_LOWER)) % len(_FREE)]
_SYMBOL[_LATIN] = _LATIN
del _c, _l


def letters_of(points: np.ndarray) -> np.ndarray:
    """Code points as letters in lower case, 0 for all else."""
    return _LOWER[np.minimum(points, len(_LOWER) - 1)]


# Signs of leetspeak and the letters they imitate.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
SEPARATORS = " .-_*'`~,:;/\\^=#&%​­"

_MARK = r"[\.\-_\*'`~,:;/\\\^=#&%​­]"
_SIGN = r"[0-9@\$!\|\+\(<\{€£¡§]"
SUSPECT = re.compile(
    rf"(?<![^\W_])(?:[^\W\d_]|{_SIGN})(?:(?: |{_MARK}{{1,2}} ?)(?:[^\W\d_]|{_SIGN})(?![^\W_])){{2,}}"  # s p a c e d
    rf"|[^\W_]*(?:[^\W\d_]|{_SIGN})*(?<=[^\W\d_])(?:{_SIGN}|{_MARK})+[^\W\d_](?:[^\W_]|{_SIGN}|{_MARK}(?=[^\W_]))*"  # l33t, l.e.e.t
    rf"|{_SIGN}[^\W\d_](?:[^\W_]|{_SIGN}|{_MARK}(?=[^\W_]))*"
    r"|[^\W\d_]*([^\W\d_])\1\1+[^\W\d_]*"  # repeeeated
)
_PARTED = re.compile(rf"(?:\s|{_MARK})+")
_DISGUISED = re.compile(rf"{_SIGN}[^\W\d_]|[^\W\d_]{_SIGN}|([^\W\d_])\1\1")
#: Letters by themselves between marks, also inside what the pattern takes as one.
_LETTERED = re.compile(rf"(?<![^\W_])(?:[^\W\d_]|{_SIGN})(?:{_MARK}(?:[^\W\d_]|{_SIGN})(?![^\W_])){{2,}}")
_HINT = re.compile(rf"{_SIGN}|{_MARK}|([^\W\d_])\1\1")
_KINDS = re.compile(rf"\s|{_MARK}")
#: Signs that the pattern, whose time is not linear, searches at once; longer places are searched in windows that overlap by half, so a suspect of up to half as many signs is seen whole.
WINDOW = 240

_TABLE = 0x2100
_IS_SIGN, _IS_MARK = np.zeros(_TABLE, dtype=bool), np.zeros(_TABLE, dtype=bool)
_IS_SIGN[[ord(c) for c in LEET]] = True
_IS_MARK[[ord(c) for c in SEPARATORS if c != " "]] = True
_IS_GAP = np.zeros(_TABLE, dtype=bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True


def suspect_ranges(points: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of a text's code points outside which no suspect can stand.

    Three signs give a place away: a letter after a sign or mark that is not
    spacing, a letter for the third time, and a letter by itself two places
    after another.  A range is the spacing-parted token there; tokens of
    letters by themselves are joined.
    """
    n = len(points)
    if n < 3:
        return []
    code = np.minimum(points, _TABLE - 1)
    low = letters_of(points)
    letter, gap = low > 0, _IS_GAP[code]
    near = np.zeros(n, dtype=bool)
    near[1:] = letter[1:] & (_IS_SIGN[code] | _IS_MARK[code])[:-1]
    near[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    solid = ~gap
    alone = solid.copy()
    alone[1:] &= gap[:-1]
    alone[:-1] &= gap[1:]
    near[2:] |= alone[2:] & alone[:-2] & (letter[2:] | letter[:-2])
    at = np.flatnonzero(near)
    if not len(at):
        return []
    begin = np.flatnonzero(solid & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(solid & np.concatenate([gap[1:], [True]])) + 1
    token = np.unique(np.searchsorted(begin, at, side="right") - 1)
    out: list[tuple[int, int]] = []
    for k in token.tolist():
        a, b = int(begin[k]), int(end[k])
        if b - a == 1 and k and end[k - 1] == a - 1 and end[k - 1] - begin[k - 1] == 1:
            a = int(begin[k - 1])
        if out and a <= out[-1][1] + (b - a == 1):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class CharModel:
    """Costs of letters after the two before, from trigram counts with back-off.

    Counts are sorted arrays of codes, so the model takes 12 bytes for each
    trigram seen, of at most 2^24.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes.astype(np.uint32), counts.astype(np.int64)
        sums = lambda key, size: np.bincount(key, weights=self.counts, minlength=size)
        self.uni, self.bi = sums(self.codes & 0xFF, 1 << 8), sums(self.codes & 0xFFFF, 1 << 16)
        self.left, self.left1 = sums(self.codes >> 8, 1 << 16), sums((self.codes >> 8) & 0xFF, 1 << 8)
        self.total = float(self.counts.sum())
        self.cost = lru_cache(1 << 16)(self._cost)

    @classmethod
    def of(cls, counts: dict[int, int]) -> CharModel:
        codes = sorted(counts)
        return cls(np.array(codes, dtype=np.uint32), np.array([counts[c] for c in codes], dtype=np.int64))

    def __reduce__(self):
        return CharModel, (self.codes, self.counts)

    def _cost(self, a: int, b: int, c: int) -> float:
        code = a << 16 | b << 8 | c
        at = int(np.searchsorted(self.codes, np.uint32(code)))
        seen = float(self.counts[at]) if at < len(self.codes) and self.codes[at] == code else 0.0
        p1 = (self.uni[c] + 0.5) / (self.total + 128)
        p2 = (self.bi[b << 8 | c] + 20 * p1) / (self.left1[b] + 20)
        p3 = (seen + 20 * p2) / (self.left[a << 8 | b] + 20)
        return -float(np.log(p3))


def lattice(suspect: str, parted: bool = False) -> list[list[tuple[str, float]]]:
    """For each sign, what it may stand for ('' for nothing) and the cost; if ``parted``, separators may be blanks."""
    out, before = [], ""
    for ch in suspect.lower():
        if ch.isalpha():
            ways = [(ch, 0.0)] if ch != before else [(ch, 1.0), ("", 0.5)]
            before = ch
        else:
            ways = [(x, 1.0) for x in LEET.get(ch, "")]
            if ch in SEPARATORS or not ways:
                ways.append(("", 0.3))
                if parted:
                    ways.append((" ", 0.3))
        out.append(ways)
    return out


def decode(suspect: str, model: CharModel, parted: bool = False) -> str:
    """The most likely letters behind a suspect, by Viterbi search."""
    # A path is its last letter and the path before, so a step costs the same at any length.
    # A state is the symbols of the last two letters: all that the model looks at, so the search is exact.
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # of the symbols
    for ways in lattice(suspect, parted):
        fresh: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for letter, extra in ways:
                if letter == " ":
                    key, value = (0, 0), (cost + extra + (model.cost(a, b, 0) if b else 0.0), (" ", path))
                elif letter:
                    c = int(_SYMBOL[letters_of(ord(letter))])
                    key, value = (b, c), (cost + extra + model.cost(a, b, c), (letter, path))
                else:
                    key, value = (a, b), (cost + extra, path)
                if key not in fresh or value[0] < fresh[key][0]:
                    fresh[key] = value
        states = fresh
    path, out = min((cost + model.cost(a, b, 0), (a, b), path) for (a, b), (cost, path) in states.items())[2], []
    while path:
        letter, path = path
        out.append(letter)
    return "".join(reversed(out))


def squeezed(suspect: str) -> str:
    """All readings apart: the letters with each run of one letter made one."""
    return re.sub(r"(.)\1+", r"\1", suspect)


def readings(suspect: str, model: CharModel) -> str:
    """Decoded words of a suspect: as one word, and where it is parted, cut at its separators and with words between them.

    A chain such as an address may hold a disguised word between separators of
    another kind, so the pieces between those of each kind are words too, and
    so are letters by themselves.
    """
    pieces = [x for x in _PARTED.split(suspect) if x]
    found = [suspect]
    if len(pieces) > 1:
        found += [x for x in pieces if _DISGUISED.search(x)]
        kinds = set(_KINDS.findall(suspect))
        if len(kinds) > 1:
            found += [x for kind in sorted(kinds) for x in suspect.split(kind) if x != suspect and (_KINDS.search(x) or _DISGUISED.search(x))]
        found += [m.group(0) for m in _LETTERED.finditer(suspect)]
    words = [decode(x, model) for x in dict.fromkeys(found)]
    if len(pieces) > 1:
        words += decode(suspect, model, parted=True).split()
    return " ".join(dict.fromkeys(y for x in words for y in (x, squeezed(x))))


def suspects(text: str, a: int, b: int) -> list[str]:
    """What the pattern finds in a range of a text, in windows where that is long."""
    if b - a <= WINDOW:
        return [m.group(0) for m in SUSPECT.finditer(text[a:b])]
    starts = range(a, b - WINDOW // 2, WINDOW // 2)
    windows = (text[k : min(k + WINDOW, b)] for k in starts)
    return list(dict.fromkeys(m.group(0) for w in windows if _HINT.search(w) for m in SUSPECT.finditer(w)))


def restored(text: str, model: CharModel, known: dict[str, str]) -> str:
    """Letters of a text in lower case, words parted by blanks; decoded suspects follow."""
    more = []
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    for a, b in suspect_ranges(points):
        for s in suspects(text, a, b):
            got = known.get(s)
            if got is None:
                got = readings(s, model)
                if len(s) <= WINDOW // 4:
                    known[s] = got
            more.append(got)
    if more:
        points = np.concatenate([points, np.frombuffer((" " + " ".join(more)).encode("utf-32-le"), dtype=np.uint32)])
    codes = letters_of(points)
    codes[codes == 0] = 32
    return " " + codes.tobytes().decode("utf-32-le") + " "


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 24, dtype=np.int64)
    for batch in batches:
        buf, offsets = string_buffer(batch.column(0))
        for i, j in blocks(offsets):
            text = buf[offsets[i] : offsets[j]].tobytes().decode("utf-8", "replace")
            codes = _SYMBOL[letters_of(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))]
            keep = np.ones(len(codes), dtype=bool)
            keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
            c = np.concatenate([[0, 0], codes[keep], [0]]).astype(np.uint32)
            code = c[:-2] << 16 | c[1:-1] << 8 | c[2:]
            code = np.where(c[1:-1] == 0, c[2:], code)
            u, n = np.unique(code, return_counts=True)
            total[u] += n
    yield from _pack(total)


def _pack(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], ["part", "codes", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 24, dtype=np.int64)
    for batch in batches:
        for r in batch.to_pylist():
            total[np.frombuffer(r["codes"], dtype=np.uint32)] += np.frombuffer(r["counts"], dtype=np.int64)
    yield from _pack(total)


def char_model(docs: DataFrame, fan_in: int = 16) -> CharModel:
    """Trigram counts over all texts of ``docs(text)``, added up in two steps to one pack of at most 2^24 codes."""
    ddl = "part int, codes binary, counts binary"
    packs = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_trigrams, ddl)
    some = packs.withColumn("part", (F.spark_partition_id() % fan_in).cast("int")).repartitionById(fan_in, "part").mapInArrow(_add, ddl)
    r = some.repartitionById(1, F.lit(0)).mapInArrow(_add, ddl).first()  # fan_in packs in one task
    if r is None:
        return CharModel.of({})
    return CharModel(np.frombuffer(bytes(r["codes"]), dtype=np.uint32), np.frombuffer(bytes(r["counts"]), dtype=np.int64))


PREFIXES = (4, 5, 6, 7, 8)


def _terms_of(text: str) -> set[str]:
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if len(w) > n)
    return out


def _term_counts(model: CharModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(_terms_of(restored(text or "", model, known)))
            terms = sorted(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    return run


def _machine(terms: list[str]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        machine.add_word(t, i)
    machine.make_automaton()
    return machine


def _found_terms(model: CharModel, terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = _machine(terms), {}
        for batch in batches:
            found = [sorted({i for _, i in machine.iter(restored(text or "", model, known))}) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["label", "terms"])

    return run


class ToxicModel:
    """Terms with their scores, the score of a text without any, and the decoder's model."""

    def __init__(self, chars: CharModel, terms: list[str], scores: list[float], base: float):
        self.chars, self.terms, self.scores, self.base = chars, terms, scores, base


#: Least shingle hashes kept of a sample text; texts of no more shingles are compared exactly.
SKETCH = 128


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = string_buffer(batch.column(2))
        for i, j in blocks(offsets):
            h, own = shingles(Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            least = [np.sort(mix(h[a:b]))[:SKETCH].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(least, pa.binary())], ["label", "key", "least"])


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sketches of two shingle sets agree to 0.75 or more."""
    if not len(a) or not len(b):
        return False
    size = SKETCH if max(len(a), len(b)) == SKETCH else len(a) + len(b)
    union = np.union1d(a, b)[:size]
    return 4 * np.isin(np.intersect1d(a, b), union).sum() >= 3 * len(union)


def _leaders(rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """(label, key) of the rows that are no near copy of one kept before, within a label."""
    kept, of = [], {}
    for label, key, least in sorted(rows, key=lambda r: r[:2]):
        of.setdefault(label, []).append((key, least))
    for label, some in of.items():
        kept += [(label, some[k][0]) for k in _unlike([least for _, least in some])]
    return kept


def _unlike(sketches: list[np.ndarray]) -> list[int]:
    """Places of the sketches that are not like one kept before.

    Sketches that are alike share three quarters of the longer one's hashes,
    so with the rarest first they share one before a sketch's last three
    quarters.  Those are what brings two together; a passage of many texts
    does not.
    """
    if not sketches:
        return []
    size = np.array([len(x) for x in sketches])
    _, code, often = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    own = np.full((len(sketches), SKETCH), len(often), dtype=np.int64)
    own[np.arange(SKETCH) < size[:, None]] = rank[code]
    own.sort(axis=1)
    held, leads, kept = np.zeros(len(often) + 1, dtype=bool), {}, []
    for k, n in enumerate(size.tolist()):
        mine = own[k, :n]
        rare = mine[: n - (3 * n + 3) // 4 + 1].tolist()
        near = np.array(sorted({j for h in rare for j in leads.get(h, ())}), dtype=np.int64)
        if len(near):
            held[mine] = True
            near = near[4 * held[own[near]].sum(axis=1) >= 3 * np.maximum(n, size[near])]
            held[mine] = False
        if any(_alike(sketches[k], sketches[j]) for j in near.tolist()):
            continue
        kept.append(k)
        for h in rare:
            leads.setdefault(h, []).append(k)
    return kept


def _without_near_copies(sample: DataFrame) -> DataFrame:
    """``sample(label, text)`` with one text of each group of near copies within a label.

    Sketches of the sample, whose rows are bounded, are compared on the driver.
    """
    rows = checkpointed(sample.select("label", F.xxhash64("text").alias("key"), "text").dropDuplicates(["label", "key"]))
    told = [(r["label"], r["key"], np.frombuffer(bytes(r["least"]), dtype=np.uint64)) for r in rows.mapInArrow(_sketches, "label int, key long, least binary").collect()]
    kept = sample.sparkSession.createDataFrame(_leaders(told), "label int, key long")
    return checkpointed(rows.join(F.broadcast(kept), ["label", "key"]).select("label", "text"))


def _most_telling(rows: list[np.ndarray], n: int, usable: np.ndarray, extra: np.ndarray, least: float) -> tuple[list[int], np.ndarray]:
    """Terms, each the one that explains most of the toxic texts that no term before it is found in; and which texts stay open.

    ``rows`` has the terms of each toxic text.
    """
    open_, picked = np.ones(len(rows), dtype=bool), []
    more = np.bincount(np.concatenate(rows), minlength=n) if rows else np.zeros(n, dtype=np.int64)
    while n and open_.any():
        gain = np.where(usable, more + extra, -1.0)
        best = int(gain.argmax())
        if more[best] < least or gain[best] <= 0:
            break
        picked.append(best)
        for k in np.flatnonzero(open_):
            if best in rows[k]:
                open_[k] = False
                more = more - np.bincount(rows[k], minlength=n)
    return picked, open_


def fit(train: DataFrame, chars: CharModel, per_label: int = 5000, least_gain: float = 0.002, least_score: float = 0.75, often: float = 0.05) -> ToxicModel | None:
    """A model from ``train(label, text)`` of labels 0 and 1."""
    some = bounded_sample(train.where("label in (0, 1) and text is not null"), "label", per_label)
    some = _without_near_copies(checkpointed(some.select("label", "text")))
    sizes = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad + good:
        return None
    counted = some.select("label", "text").mapInArrow(_term_counts(chars), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    lift = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    ranked = sorted(r["term"] for r in counted.where((F.col("t") >= 2) & (lift > 2.0)).select("term").collect())  # terms of 2 * per_label texts
    rows = some.select("label", "text").mapInArrow(_found_terms(chars, ranked), "label int, terms array<int>").collect() if ranked else []
    hit = {label: [np.array(r["terms"], dtype=np.int64) for r in rows if r["label"] == label] for label in (0, 1)}
    n = len(ranked)
    clean, toxic = (np.bincount(np.concatenate(hit[k]), minlength=n) if hit[k] else np.zeros(n, dtype=np.int64) for k in (0, 1))
    scores = (toxic + 0.5) / (toxic + clean + 1)
    whole = np.array([t.endswith(" ") for t in ranked], dtype=bool)
    extra = -10.0 * clean * bad / max(good, 1) + 0.1 * whole + 0.01 * np.array([len(t) for t in ranked])
    hit = {k: hit[k] or [np.zeros(0, dtype=np.int64)] * m for k, m in ((0, good), (1, bad))}
    picked, open_ = _most_telling(hit[1], n, scores >= least_score, extra, max(3, least_gain * bad))
    common = whole & (clean == 0) & (toxic >= max(5, often * bad))
    picked += [int(i) for i in np.flatnonzero(common) if i not in picked]
    rest = sum(not np.isin(picked, x).any() for x in hit[0])
    base = float(open_.sum() + 0.5) / (open_.sum() + rest + 1)
    return ToxicModel(chars, [ranked[i] for i in picked], [float(scores[i]) for i in picked], base)


def _score(model: ToxicModel | None, n_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        machine = _machine(model.terms) if model is not None and model.terms else None
        for batch in batches:
            score = []
            for text in batch.column(n_kept):
                best = 0.0 if model is None else model.base
                if machine is not None:
                    if len(known) > 200_000:
                        known.clear()
                    for _, i in machine.iter(restored(text.as_py() or "", model.chars, known)):
                        best = max(best, model.scores[i])
                score.append(round(best, 6))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n_kept)), pa.array(score, pa.float64())], [*batch.schema.names[:n_kept], "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicModel | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the score of each row of ``docs``."""
    rows, ddl = carried(docs, keep)
    return named(rows.mapInArrow(_score(model, len(keep)), f"{ddl}, score double"), keep)
