"""Exact removal of passages that recur anywhere in the corpus.

A window is ``window`` consecutive words of one document.  Every word that
some window covers, whose word sequence also starts anywhere else (the same
document included), is removed; windows are judged on the input.

How it runs, for texts of any total size:

1. *Proposals.*  Each task hashes all windows of its documents and deals 32
   bits of each hash to shards by hash range.  A hash that recurs within one
   block of documents is settled there and sent once for the whole block, so
   a passage that stands in a third of all documents never fills a shard.  A
   shard answers each document with one bit for each window: may it recur?
   Every window that recurs is proposed, and a few others are.
2. *Confirmation.*  Proposed windows travel as words.  Consecutive windows go
   together as long as the ``phrase`` words of least hash in them are the same
   place, so equal windows meet in the shard of that phrase.  A block sends
   each such piece of text once, with the places that it stands at.  Under
   each phrase the shard counts windows by their words; those that stand
   twice are confirmed, and maximal runs of them are the recurring passages.
3. *Automata.*  A shard compiles its distinct passages into Aho-Corasick
   automata of at most ``shard_words`` words, one symbol for each distinct
   word, and streams past them the pieces of all documents that were sent.
   The occurrences they locate, and nothing else, are the words to
   remove; they travel back to the documents by row key.

Shuffled are 4 bytes a word, each text once (its exchange is used twice), and
proposed words about three times.  The number of shards grows with the counted
bytes of text.  Nothing is collected or broadcast.

Defined results: a null text has no words; the kept text of a document with
no words is empty; a null ``doc_id`` is an id like any other; repeated rows
count as separate documents, so all their windows recur; a text longer than a
block is a block of its own, read whole; an empty table gives an empty result.
Columns of the input other than ``doc_id`` and ``text`` never clash, as they
are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .replies import ANSWERS_DDL, PACKED_DDL, packed, unpacked
from .session import row_key, shards_of
from .textnp import Words, binary_slices, blocks, cut, grams, grouped, mix, pack_bits, string_buffer, wide, within

#: Bytes of text in which recurring windows are settled on the spot.
LOCAL_BYTES = 4 << 20
#: Bytes of a window's hash that are sent to its shard, beside the shard's number; words are compared later.
SENT = 4
#: Symbols for words: code points less the surrogates and 0.
SYMBOLS = 0x110000 - 0x800 - 1


def window_hashes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows' hashes, and offsets of each document's windows."""
    g = grams(words.hashes(), window, seed=35)[within(words.first, window, len(words))] if len(words) >= window else np.zeros(0, dtype=np.uint64)
    return g, grouped(np.maximum(words.counts - window + 1, 0))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h, 3) % np.uint64(shards)).astype(np.int32)


_SENT = "shard int, rid long, ids binary, counts binary, hashes binary, bits binary"


def _send(window: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("rid", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            buf, offsets = string_buffer(batch.column(1))
            for i, j in blocks(offsets, LOCAL_BYTES):
                words = Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h, own = window_hashes(words, window)
                s = np.sort(h)
                again = np.zeros(len(s), dtype=bool)
                again[1:] = s[1:] == s[:-1]
                twice = np.unique(s[again])
                at = np.searchsorted(twice, h)
                local = twice[np.minimum(at, max(len(twice) - 1, 0))] == h if len(twice) else np.zeros(len(h), dtype=bool)
                bits, bounds = pack_bits(local, own)
                n = j - i
                none = pa.nulls(n, pa.binary())
                home = shard_of(rids[i:j].astype(np.int64).view(np.uint64), shards)
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(rids[i:j]), none, none, none, binary_slices(bits, bounds)], schema=schema)
                doc = np.repeat(np.arange(n), np.diff(own))[~local]
                mine = h[~local]
                shard = shard_of(mine, shards)
                order = np.argsort(shard.astype(np.int64) * n + doc, kind="stable")
                doc, mine, shard = doc[order], mine[order], shard[order]
                shared = shard_of(twice, shards)
                rows = []
                for k in np.unique(np.concatenate([shard, shared])):
                    a, b = np.searchsorted(shard, [k, k + 1])
                    d, c = np.unique(doc[a:b], return_counts=True)
                    rows.append((int(k), None, rids[i:j][d].astype(np.int64).tobytes(), c.astype(np.uint32).tobytes(), cut(np.concatenate([mine[a:b], twice[shared == k]]), SENT), None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _propose(homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            local = batch.column("rid").is_valid()
            here = batch.filter(local)
            if here.num_rows:
                yield from packed(-1, here.column("rid").to_numpy(), here.column("bits"), homes)
            for r in batch.filter(pa.compute.invert(local)).select(["shard", "ids", "counts", "hashes"]).to_pylist():
                sent.setdefault(r["shard"], []).append((r["ids"], r["counts"], r["hashes"]))
        for shard, parts in sent.items():
            s = np.concatenate([wide(x[2], SENT) for x in parts])
            s.sort()
            again = np.zeros(len(s), dtype=bool)
            again[1:] = s[1:] == s[:-1]
            twice = np.unique(s[again])
            del s, again
            if not len(twice):
                continue
            rids, replies = [], []
            for ids, counts, hashes in parts:
                own = grouped(np.frombuffer(counts, dtype=np.uint32))
                h = wide(hashes, SENT)[: own[-1]]
                hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
                found = np.flatnonzero(np.diff(grouped(hit)[own]))
                bits, bounds = pack_bits(hit, own)
                rids.append(np.frombuffer(ids, dtype=np.int64)[found])
                replies.append(binary_slices(bits, bounds).take(pa.array(found)))
            yield from packed(shard, np.concatenate(rids), pa.concat_arrays(replies), homes)

    return run


def recurring(h: np.ndarray, answers: list[dict], shards: int) -> np.ndarray:
    """One document's windows that recur, from the answers to its row key."""
    n = len(h)
    local = [a["bits"] for a in answers if a["shard"] < 0]
    if len(local) > 1:  # the same row again
        return np.ones(n, dtype=bool)
    out = np.zeros(n, dtype=bool)
    if local and local[0]:
        out = np.unpackbits(np.frombuffer(local[0], dtype=np.uint8), bitorder="little")[:n].astype(bool)
    mine = np.flatnonzero(~out)
    if len(answers) > len(local) and len(mine):
        shard = shard_of(h[mine], shards)
        order = np.argsort(shard, kind="stable")
        starts = np.searchsorted(shard[order], np.arange(shards + 1))
        for a in answers:
            if a["shard"] >= 0:
                x, y = starts[a["shard"]], starts[a["shard"] + 1]
                out[mine[order[x:y]]] = np.unpackbits(np.frombuffer(a["bits"], dtype=np.uint8), bitorder="little")[: y - x]
    return out


def runs(flags: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Word ranges that the flagged windows cover, each without a gap of windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        yield int(a), int(b) + window - 1


class Alphabet:
    """Words as characters: one each, or two of two halves of the alphabet where there are more words than characters."""

    def __init__(self, words: dict[bytes, int], symbols: int = SYMBOLS):
        self.half = symbols // 2
        self.width = 1 if len(words) <= symbols else 2
        if len(words) > self.half**2:
            raise ValueError("a shard has too many distinct words; use smaller shards")

    def spell(self, codes: list[int]) -> str:
        code = np.array(codes, dtype=np.uint32)
        if self.width == 2:
            code = np.stack([code % self.half, self.half + code // self.half], axis=1).ravel()
        code += 1
        code[code >= 0xD800] += 0x800
        return code.astype("<u4").tobytes().decode("utf-32-le")


class Automata:
    """Passages, spelled, compiled into Aho-Corasick automata of at most ``shard_words`` words (or of one passage)."""

    def __init__(self, passages: set[str], shard_words: int, width: int = 1):
        self.machines: list[ahocorasick.Automaton] = []
        self.width = width
        machine, size = None, 0
        for p in sorted(passages):
            if machine is None or size + len(p) > shard_words * width and size:
                self._close(machine)
                machine, size = ahocorasick.Automaton(), 0
            machine.add_word(p, len(p))
            size += len(p)
        self._close(machine)

    def _close(self, machine) -> None:
        if machine is not None:
            machine.make_automaton()
            self.machines.append(machine)

    def covered(self, texts: list[str]) -> list[np.ndarray]:
        """Which words of each text lie in an occurrence of a passage; all texts pass one automaton after another."""
        steps = [np.zeros(len(text) // self.width + 1, dtype=np.int32) for text in texts]
        for machine in self.machines:
            for text, step in zip(texts, steps, strict=True):
                for last, size in machine.iter(text):
                    step[(last + 1 - size) // self.width] += 1
                    step[(last + 1) // self.width] -= 1
        return [np.cumsum(step[:-1]) > 0 for step in steps]


def anchors(g: np.ndarray, at: np.ndarray, places: int) -> np.ndarray:
    """For windows that start at ``at``, the place of the least of the ``places`` phrase hashes in each, the first if equal."""
    least, where = g[at], np.zeros(len(at), dtype=np.int64)
    for k in range(1, places):
        other = g[at + k]
        less = other < least
        least = np.where(less, other, least)
        where[less] = k
    return at + where


_PIECES = "shard int, phrases binary, rids binary, places binary, counts binary, sizes binary, text binary"


def _pieces(window: int, phrase: int, shards: int):
    """Proposed windows as pieces of text, each once for a block, with the (row, word) places it stands at."""
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(1).to_numpy().astype(np.int64)
            buf, offsets = string_buffer(batch.column(2))
            for i, j in blocks(offsets, LOCAL_BYTES):
                text, answers = Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), batch.column(3).slice(i, j - i).to_pylist()
                h, own = window_hashes(text, window)
                flags = np.zeros(len(h), dtype=bool)
                for d, got in enumerate(answers):
                    if got and own[d] < own[d + 1]:
                        flags[own[d] : own[d + 1]] = recurring(h[own[d] : own[d + 1]], got, shards)
                some = np.flatnonzero(flags)
                if not len(some):
                    continue
                doc = np.searchsorted(own, some, side="right") - 1
                first = some - own[doc] + text.first[doc]
                g = grams(text.hashes(), phrase, seed=36)
                anchor = anchors(g, first, window - phrase + 1)
                new = np.ones(len(some), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(some)) - 1
                found: dict[tuple[int, bytes], list] = {}
                words = {d: buf[offsets[i + d] : offsets[i + d + 1]].tobytes().split() for d in np.unique(doc).tolist()}
                base = text.first
                for d, a, b, at in zip(doc[begin].tolist(), first[begin].tolist(), (first[end] + window).tolist(), anchor[begin].tolist(), strict=True):
                    x = a - int(base[d])
                    piece = b" ".join(words[d][x : b - int(base[d])])
                    found.setdefault((at - a, piece), [int(g[at])]).append((int(rids[i + d]), x))
                by: dict[int, list] = {}
                for (at, piece), (name, *places) in found.items():
                    by.setdefault(name, []).append((at, piece, places))
                names_ = np.array(list(by), dtype=np.uint64)
                rows: dict[int, list] = {}
                for k, name in zip(shard_of(names_, shards).tolist(), by, strict=True):
                    rows.setdefault(k, []).extend(by[name])
                out = []
                for k, pieces in rows.items():
                    places = np.array([p for _, _, ps in pieces for p in ps], dtype=np.int64).reshape(-1, 2)
                    out.append((k, np.array([x[0] for x in pieces], dtype=np.uint8).tobytes(), places[:, 0].tobytes(), places[:, 1].astype(np.int32).tobytes(), np.array([len(x[2]) for x in pieces], dtype=np.int32).tobytes(), np.array([len(x[1]) for x in pieces], dtype=np.int32).tobytes(), b"".join(x[1] for x in pieces)))
                types = [pa.int32()] + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


class Piece:
    """A piece of text: its words as numbers, then spelled; how often it stands, and where."""

    __slots__ = ("codes", "text", "count", "spots")

    def __init__(self, codes: list[int]):
        self.codes, self.text, self.count, self.spots = codes, "", 0, []


def passages_of(group: list[Piece], window: int, width: int = 1) -> set[str]:
    """Maximal runs of windows that stand twice by their words, in the pieces of one phrase."""
    out = set()
    size = window * width
    seen: dict[str, int] = {}
    if len(group) > 1 and any(p.count == 1 for p in group):
        for p in group:
            for a in range(0, len(p.text) - size + 1, width):
                key = p.text[a : a + size]
                seen[key] = seen.get(key, 0) + p.count
    for p in group:
        if p.count > 1:
            out.add(p.text)
        elif seen:
            flags = np.array([seen[p.text[a : a + size]] > 1 for a in range(0, len(p.text) - size + 1, width)], dtype=bool)
            out.update(p.text[a * width : b * width] for a, b in runs(flags, window))
    return out


def _locate(window: int, phrase: int, homes: int, shard_words: int):
    """Confirmed passages of a shard, found in all pieces it was sent, as word ranges for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        groups: dict[bytes, dict[bytes, Piece]] = {}
        shard = 0
        for batch in batches:
            for r in batch.to_pylist():
                shard, at, spot = r["shard"], 0, 0
                rid, place = np.frombuffer(r["rids"], dtype=np.int64), np.frombuffer(r["places"], dtype=np.int32)
                for x, n, size in zip(r["phrases"], np.frombuffer(r["counts"], dtype=np.int32).tolist(), np.frombuffer(r["sizes"], dtype=np.int32).tolist(), strict=True):
                    raw = r["text"][at : at + size]
                    at += size
                    words = raw.split(b" ")
                    group = groups.setdefault(b" ".join(words[x : x + phrase]), {})
                    p = group.get(raw)
                    if p is None:
                        p = group[raw] = Piece([numbers[w] for w in words])
                    p.count += n
                    p.spots.append((rid[spot : spot + n], place[spot : spot + n]))
                    spot += n
        alphabet = Alphabet(numbers)
        pieces = [p for group in groups.values() for p in group.values()]
        for p in pieces:
            p.text, p.codes = alphabet.spell(p.codes), []
        passages: set[str] = set()
        for group in groups.values():
            passages |= passages_of(list(group.values()), window, alphabet.width)
        del groups, numbers
        covered = Automata(passages, shard_words, alphabet.width).covered([p.text for p in pieces])
        for a in range(0, len(pieces), 20_000):
            rids, ranges = [], []
            for p, gone in zip(pieces[a : a + 20_000], covered[a : a + 20_000], strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).astype(np.int32)
                if len(edge):
                    for rid, place in p.spots:
                        rids.append(rid)
                        ranges += [(edge + x).tobytes() for x in place]
            if rids:
                yield from packed(shard, np.concatenate(rids), pa.array(ranges, pa.binary()), homes)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
    for batch in batches:
        buf, offsets = string_buffer(batch.column(2))
        answers, words, gone, kept = batch.column(3), [], [], []
        for d in range(batch.num_rows):
            text = buf[offsets[d] : offsets[d + 1]].tobytes().split()
            got = answers[d].as_py()
            out = 0
            if got:
                step = np.zeros(len(text) + 1, dtype=np.int64)
                for x in got:
                    edge = np.frombuffer(x["bits"], dtype=np.int32)
                    np.add.at(step, edge[::2], 1)
                    np.add.at(step, edge[1::2], -1)
                cover = np.cumsum(step[:-1]) > 0
                out = int(cover.sum())
                text_kept = [w for w, x in zip(text, cover.tolist(), strict=True) if not x]
            words.append(len(text))
            gone.append(out)
            kept.append(b" ".join(text_kept if out else text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)


def substring_dedup(docs: DataFrame, window: int = 35, phrase: int = 8, shard_words: int = 1_000_000, shard_bytes: int = 256 << 20) -> DataFrame:
    """``docs(doc_id, text)`` without its recurring passages.

    Returns doc_id, n_words, n_removed and the kept text, words joined by one
    space.  ``shard_words`` bounds the words that one automaton compiles,
    ``shard_bytes`` the text whose windows one shard takes on average.
    """
    shards = shards_of(docs, "text", shard_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("rid"), "text")
    sent = rows.select("rid", "text").mapInArrow(_send(window, shards), _SENT)
    said = sent.repartitionById(shards, "shard").mapInArrow(_propose(shards), PACKED_DDL)
    proposed = said.repartitionById(shards, "home").mapInArrow(unpacked, ANSWERS_DDL)
    pieces = rows.join(proposed, "rid").select("doc_id", "rid", "text", "answers").mapInArrow(_pieces(window, phrase, shards), _PIECES)
    found = pieces.repartitionById(shards, "shard").mapInArrow(_locate(window, phrase, shards, shard_words), PACKED_DDL)
    covers = found.repartitionById(shards, "home").mapInArrow(unpacked, ANSWERS_DDL)
    return rows.join(covers, "rid", "left").select("doc_id", "rid", "text", "answers").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, text string")
