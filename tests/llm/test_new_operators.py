"""Importance resampling, budgeted chat windows and conversation repair against plain versions of themselves."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from test_corpus import SCHEMA

from terragrain.llm import chat
from terragrain.llm import importance as imp
from terragrain.llm import repair as rep


def brute_importance(docs, target, n=2, buckets=10_000, percent=25, least=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    feats = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    words = [split(t) for _, t in docs]
    found = [feats(w) for w in words]
    s, t = Counter(b for f in found for b in f), Counter(b for x in target for b in feats(split(x)))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for (key, _), w, f in zip(docs, words, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    may = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    rank = {id(x): k + 1 for k, x in enumerate(may[: percent * len(may) // 100])}
    return [(*x[:4], rank.get(id(x))) for x in out]


TEXTS = [None, "", " \n\t", "...!?", "One", "one ONE oNe", "é É ß x1 2", "a-b-c d_e", "x" * 300 + " " + "y" * 50, "日本語 テキスト and words", "w " * 500, "a b c d e f g h i j k l m n o p q r s t u v"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "Cat", "dog's", "zebra", "née"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(5, texts[20]), (5, texts[20]), (None, texts[30]), (None, None)]
    return rows, spark.createDataFrame([(*r, "en", "s", None, 1, 2, "x", "y", 3, True) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "piece"), [(2, 2 << 20), (2, 40), (3, 16), (1, 64)])
def test_importance(spark, odd_docs, monkeypatch, n, piece):
    """Whole results, also where texts are read in pieces of a few bytes, cut between and beside words."""
    monkeypatch.setattr(imp, "BLOCK_BYTES", piece)
    rows, docs = odd_docs
    target = ["the cat of the zebra", None, "", "dog's dog's née"]
    got = imp.importance(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=997)
    want = brute_importance(rows, target, n, 997)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == sorted(want, key=repr)


def test_importance_of_nothing(spark, odd_docs):
    rows, docs = odd_docs
    none = spark.createDataFrame([], "text string")
    assert imp.importance(docs.limit(0), docs).count() == 0
    got = imp.importance(docs, none).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_importance(rows, []), key=repr)
    drawn = imp.resampled(docs, none)
    assert drawn.columns == docs.columns and 0 < drawn.count() < len(rows)


def test_crc_algebra():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(0, 256, rng.integers(0, 70), dtype=np.uint8).tobytes() for _ in range(2))
        at = np.array([zlib.crc32(a)], dtype=np.uint32)
        assert (imp.shifted(at, np.array([len(b)])) ^ np.uint32(zlib.crc32(b)))[0] == zlib.crc32(a + b)


def brute_repair(rows):
    """Plain dynamic programming over whole audits, and a repair that follows the audit."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(best):
        for _ in range(2):
            for q, (c, x) in list(best.items()):
                for r, to in follow[q].items():
                    if r != "s":
                        best[to] = min(best.get(to, (10**9, "")), (c + 3, x + "I"))
        return best

    best = inserted({0: (0, "")})
    for (_, role, _), kind in zip(rows, kinds, strict=True):
        new = {}
        for q, (c, x) in best.items():
            moves = [(q, 4, "D")]
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                moves += [(to, more, "K") if r == role[:1] else (to, 3 + more, "R") for r, to in follow[q].items() if r == role[:1] or r != "s"]
            for to, cost, edit in moves:
                new[to] = min(new.get(to, (10**9, "")), (c + cost, x + edit))
        best = inserted(new)
    cost, audit = min(best[q] for q in (0, 3) if q in best)
    out, state, left = [], 0, list(rows)
    for edit in audit:
        turn = None if edit == "I" else left.pop(0)
        if edit == "D":
            continue
        made = "user" if state in (0, 1, 3) else "assistant"
        role = turn[1] if edit == "K" else made
        state = 1 if role[:1] == "s" else 2 if role[:1] == "u" else 3
        out.append(f"{role}:{turn[2] if turn else ''}")
    turns = {t for t, _, _ in rows if t is not None}
    first = "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for _, r, _ in rows)
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def make_turns(seed=5, most=14):
    rng = random.Random(seed)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 1, "user", "Hi."), (None, 0, "assistant", None), (3, None, None, None), (3, None, "user", "What?")]
    for conv in range(10, 70):
        for k in range(rng.randrange(1, most)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            text = rng.choice([None, "", " \t", "yes", "no", "Fine.", "Really?\n", "\\ <s> \\</s>", "[[INST]", "<<SYS>> <</SYS>>[ROLE]x[/ROLE] ", "é日本 [/INST", "w " * rng.randrange(1, 300) + "."])
            rows.append((conv, None if rng.random() < 0.05 else k + rng.randrange(2), role, text))
    rows += [(80, k, "user" if k % 3 else "assistant", rng.choice(["same", "same.", f"text {k}.", f"text {k}"])) for k in range(700)]
    rows += [(81, k, "user", "again") for k in range(400)] + [(82, 5, "user", f"one {k}.") for k in range(300)] + [rows[9], rows[9]]
    return rows


@pytest.fixture(scope="module")
def turns(spark):
    rows = make_turns()
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, slice int, copy string").repartition(3)


def test_repair(turns, monkeypatch):
    """All rows against plain dynamic programming, with short and with long pieces and slices."""
    rows, df = turns
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(rest)
    want = {c: brute_repair(x) for c, x in by.items()}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for piece in (256, 5):
        monkeypatch.setattr(rep, "PIECE", piece)
        got = {r.conv_id: tuple(r[n] for n in names) for r in rep.repair(df).collect()}
        assert got == want
    sliced = {r.conv_id: r.audit for r in rep.structure(df.na.fill(" ", ["role", "text"]), slice_turns=40).collect()}
    assert sliced == {c: x[6] for c, x in want.items()}
    assert rep.repair(df.limit(0)).count() == 0


def test_pieces_of_a_search(monkeypatch):
    """Random signs in pieces of every length, runs of one role included, give one audit."""
    rng = random.Random(9)
    for k in range(120):
        signs = "".join(rng.choice("suaxtvbySUA" if k % 2 else "uuuat") for _ in range(rng.randrange(40)))
        found = set()
        for piece in (1, 2, 7, 256):
            monkeypatch.setattr(rep, "PIECE", piece)
            found.add(rep.cheapest_edits(signs))
        assert len(found) == 1
    began = time.time()
    monkeypatch.setattr(rep, "PIECE", 256)
    assert len(rep.cheapest_edits("u" * 60_000)[1]) >= 60_000 and time.time() - began < 30


def test_order_keys():
    rng = random.Random(2)
    for _ in range(300):
        base = ["".join(rng.choice("DIKR") for _ in range(rng.randrange(12))) for _ in range(3)]
        some = list(dict.fromkeys(rng.choice(base)[: rng.randrange(13)] + "".join(rng.choice("DKR") for _ in range(3)) for _ in range(4)))
        some += [some[0] + "I", some[0] + "II"]
        keys = rep.order_keys(some)
        for a, b in itertools.permutations(range(len(some)), 2):
            for x, y in (("", ""), ("K", "D"), ("IK", "K"), ("IIK", "R")):
                assert (some[a] + x < some[b] + y) == (keys[a] + x < keys[b] + y) or some[a] + x == some[b] + y


def read_back(text):
    """Turns of a formatted text by a plain reader of its own."""
    turns, at = [], 0
    plain = lambda s: re.sub(r"\\(\\?)", r"\1", s)
    while at < len(text):
        for begin, end, role in (("<<SYS>>\n", "\n<</SYS>>\n", "system"), ("<s>[INST] ", " [/INST]", "user"), (" ", " </s>", "assistant"), ("[ROLE]", " [/ROLE]", None)):
            if text.startswith(begin, at):
                to = text.index(end, at + len(begin))
                body = text[at + len(begin) : to]
                if role is None:
                    role, body = body.split("[INST] ", 1)
                    role = plain(role)
                turns.append((role, plain(body)))
                at = to + len(end)
                break
        else:
            raise AssertionError(text[at : at + 40])
    return turns


@pytest.mark.parametrize(("budget", "history", "slice_turns"), [(2048, 256, 1024), (60, 12, 1024), (60, 12, 50), (8, 0, 7)])
def test_chat_windows(turns, budget, history, slice_turns):
    """Every turn is fresh once and in order; budgets, system turns, history and masks are as stated."""
    rows, df = turns
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    windows = {}
    for w in chat.chat_windows(df, budget, history, slice_turns).orderBy("conv_id", "slice", "window").collect():
        windows.setdefault(w.conv_id, []).append(w)
    assert set(windows) == set(by)
    for c, have in windows.items():
        want = [x[1:] for x in sorted(by[c], key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))]
        fresh, learned = [], []
        for k, w in enumerate(have):
            read = read_back(w.text)
            assert len(read) == w.repeated + w.fresh
            first = want[0] if want[0][0] == "system" else None
            own = read[: w.repeated]
            if k and first and len(first[1].encode()) + 25 <= budget // 4 * 4:
                assert own[0] == first
                own = own[1:]
            assert own == fresh[len(fresh) - len(own) :] or own and own[0] == first
            fresh += read[w.repeated :]
            learned += [w.text[s.start : s.start + s.length] for s in w.loss]
            assert w.tokens <= budget or w.fresh == 1
            assert len(w.loss) == sum(r == "assistant" for r, _ in read[w.repeated :])
        assert fresh == want
        assert [re.sub(r"\\(\\?)", r"\1", x) for x in learned] == [x for r, x in want if r == "assistant"]
    sizes = sorted(map(len, windows.values()))
    assert budget > 100 or sizes[-1] > 20


def test_chat_digests(turns):
    rows, df = turns
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    want = {}
    for c, x in by.items():
        x.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        loss = "".join(t for _, r, t in x if r == "assistant")
        want[c] = (len(x), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in x).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digests(chat.chat_windows(df, 100, 20, 64)).collect()}
    assert got == want
    assert chat.chat_digests(chat.chat_windows(df.limit(0))).count() == 0
