"""Corpus operators against brute force on small tables with odd rows."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terragrain.llm import language_id, quality_knn, toxicity
from terragrain.llm.decontaminate import decontaminated, find_leaks
from terragrain.llm.line_dedup import deduplicated, line_dedup
from terragrain.llm.mixing import mix
from terragrain.llm.ngram_join import ngram_components, one_of_each
from terragrain.llm.quality_rules import passing, quality_rules
from terragrain.llm.substring_dedup import substring_dedup
from terragrain.llm.warc import read_warc, round_trip, write_warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns named like the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, n int, label string, h string, shard int, kept boolean"


def words(text):
    return WORD.findall(text or "")


def make_docs():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, texts = line(60), []
    for _ in range(12):
        texts.append("\n".join(line(rng.randint(3, 12)) for _ in range(rng.randint(1, 8))))
    texts += [texts[0], texts[0].replace("w1", "w2", 1), texts[1] + " tail", shared, f"a b c {shared} d e", f"{shared}\n{shared}"]
    texts += [None, "", "  \n\t ", "one two", "one two", "x " * 90, "\n\n a\n\n a\n a\nb\n a\n a\nb", "É é ß\tÀ\vz\fq", line(3000), "A B C D E", "a b c d e"]
    block = "\n".join(["first line here", "second line here", "third line here"])
    texts += [f"{block}\nmore one", f"zero\n{block}\nmore two", f"{block}"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s1", "s2", None][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "null id row with some words in it", "en", "s1"), (None, None, None, None)]
    return [(*r, None, 1, 2, "x", "y", 3, True) for r in rows]


DOCS = make_docs()


def open_documents(folder):
    return [t or "" for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, empty):
    every = [words(r[1]) for r in DOCS]
    starts = Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    want = []
    for r, w in zip(DOCS, every, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, substring_dedup(docs, shard_words=70).collect()), key=key) == sorted(want, key=key)
    assert substring_dedup(empty).count() == 0


def shingle_set(text):
    w = words(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), ids.get(find(i), r[0])) for i, r in enumerate(rows)]


def test_ngram_components(docs, empty):
    got = [tuple(r) for r in ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(brute_components(DOCS), key=str)
    assert ngram_components(empty).count() == 0
    assert one_of_each(empty).count() == 0
    left = one_of_each(docs)
    assert left.columns == docs.columns
    assert len({(r[2], r[0]) for r in brute_components(DOCS)}) >= left.count() == len({c if n else ("none", d) for d, n, c in brute_components(DOCS)})


def test_ngram_near_copies(spark):
    """A chain and a large group of near copies, where links are partial."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"e{rng.randrange(10_000)}"
        rows.append((k, " ".join(w)))
    chain = [f"c{i}" for i in range(60)]
    for k in range(10):
        rows.append((200 + k, " ".join(chain)))
        chain = chain[3:] + [f"c{100 + 3 * k + j}" for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_components(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_decontamination(spark, docs, empty):
    items = [(1, "w5 w9 " + DOCS[4][1].replace("\n", ", ")[:200]), (2, DOCS[15][1].upper()), (3, "one two"), (4, None), (5, ""), (None, "first line here second line here"), (2, DOCS[15][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for item, text in set(items):
        w = split(text)
        if w:
            n = min(5, len(w))
            g = grams(w, n)
            want |= {(r[0], item, len(g), len(g & grams(split(r[1]), n))) for r in DOCS if 100 * len(g & grams(split(r[1]), n)) >= 75 * len(g)}
    got = {(r.doc_id, r.item_id, r.m, r.shared) for r in find_leaks(docs, bench).collect()}
    assert got == want and any(i == 2 for _, i, *_ in got)
    assert find_leaks(docs, bench, broadcast_rows=0).count() == find_leaks(docs, bench).count()
    leaky = {r[0] for r in want}
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & (leaky - {None}) == set()
    assert find_leaks(empty, bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def test_line_dedup(docs, empty):
    # rows that repeat wholly are judged as one
    order = sorted({(r[0] if r[0] is not None else 1 << 62, r[1]) for r in DOCS if r[1]})
    seen, gone = set(), {}
    for i, t in order:
        lines = [k for k, x in enumerate(t.split("\n")) if words(x)]
        parts = t.split("\n")
        out = set()
        for a in range(len(lines) - 2):
            run = tuple(parts[lines[a + b]] for b in range(3))
            if run in seen:
                out |= set(lines[a : a + 3])
            seen.add(run)
        gone[i, t] = out
    want = []
    for r in DOCS:
        if r[1] is None:
            want.append((r[0], 0, 0, None))
            continue
        out = gone.get((r[0] if r[0] is not None else 1 << 62, r[1]), set())
        want.append((r[0], sum(bool(words(x)) for x in r[1].split("\n")), len(out), "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in out)))
    got = [(r.doc_id, r.n_lines, r.n_removed, r.kept) for r in line_dedup(docs, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[2] for w in want)
    assert deduplicated(docs).columns == docs.columns and deduplicated(docs).count() == len(DOCS)
    assert line_dedup(empty, ["doc_id"]).count() == 0


def test_line_dedup_of_long_lines(docs, spark):
    """Runs of one and two lines go when they have over 50 words, against brute force."""
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b, c, d, e = line("a", 51), line("b", 30), line("c", 30), line("d", 50), line("e", 25)
    texts = [f"{a}\n{b}\n{c}", a, f"x\n{a}\n\ny", f"{b}\n \n{c}\nz", b, f"{d}\n{e}\n{e}", d, f"{e}\n{e}", "p\nq\nr", "p\nq\nr", f"{a}\n{a}"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + r[0], r[1]) for r in DOCS if r[0] is not None and r[1]]
    seen, want = set(), {}
    for i, t in sorted(set(rows)):
        parts = t.split("\n")
        lines, out = [k for k, x in enumerate(parts) if words(x)], set()
        for at in range(len(lines)):
            for n in (1, 2, 3):
                run = tuple(parts[k] for k in lines[at : at + n])
                if len(run) == n and (n == 3 or sum(len(words(x)) for x in run) > 50):
                    if run in seen:
                        out |= set(lines[at : at + n])
                    seen.add(run)
        want[i] = "\n".join(x for k, x in enumerate(parts) if k not in out)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in deduplicated(df).collect()}
    assert got == want
    assert got[1] == "" and got[2] == "x\n\ny" and got[3] == " \nz" and got[4] == b and got[6] == d and got[10] == ""


def test_mix(docs, empty):
    got = mix(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(words(r[1]))) for r in DOCS)
    size = Counter()
    for r in DOCS:
        size[r[3]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    left = sum(size.values())
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        target.update({s: 3 * size[s] for s in over})
        left -= sum(3 * size[s] for s in over)
        free -= over
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 32 for s in names)
    assert sorted(map(str, mix(docs.repartition(5)).select("doc_id", "taken").collect())) == sorted(map(str, mix(docs).select("doc_id", "taken").collect()))
    assert mix(empty).count() == 0


def test_quality_rules(docs, empty):
    def brute(t):
        w, seen, dup = words(t), set(), 0
        for x in (t or "").split("\n"):
            if words(x):
                dup += x in seen
                seen.add(x)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), failed

    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *brute(r[1])) for r in DOCS], key=str)
    assert passing(docs).columns == docs.columns and quality_rules(empty).count() == 0


def test_robust_outliers(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 80)))
    rows = [(i, text(), "en", "s") for i in range(300)]
    rows += [(1000 + i, text().replace(" ", "*** "), "en", "s") for i in range(15)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept for i in range(15))


def test_warc_round_trip(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/ b", "same"), (2, "http://b", "same"), (5, None, "same"), (3, "http://c", None), (4, "http://d", ""), (6, "http://e", trap), (7, "u", "é" * 50), (None, "n", "lone"), (8, "z", trap * 50)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string")
    got = {r.page_id: r for r in round_trip(pages, file_bytes=4000).collect()}
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), i if i is not None else -1)
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        last = top[h or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if i == last or last < 0 else ("revisit", last))
    write_warc(pages, f"{tmp_path}/w", revisit_bytes=10)
    back = {r.page_id: r for r in read_warc(spark, f"{tmp_path}/w", payloads=True).collect()}
    assert back[1].record_type == "response" and bytes(back[6].payload).decode() == trap
    assert round_trip(pages.limit(0)).count() == 0


def _record(payload: bytes, kind: str = "response", length: int | None = None) -> bytes:
    return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <x:%d>\r\nContent-Length: %d\r\n\r\n" % (kind.encode(), len(payload), len(payload) if length is None else length) + payload + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_many_ranges(spark, tmp_path, packed):
    """Chains over byte ranges, with traps, long payloads and payloads that end in blank lines at range borders."""
    rng = random.Random(9)
    trap = _record(b"trap")
    deep = b"WARC/1.1\r\nContent-Length: 5\r\nA: b\r\n"
    payloads = [b"", b"\r\n", b"\r\n\r\n", b"a\r", b"x" * 9000, trap * 70, deep * 90, b"A: b\r\n" * 700, b"WARC/1.1\r\n" * 300, _record(b"", length=10**9), b"no header" + trap[:-1], bytes(range(256)) * 20]
    payloads += [b"line\n" * rng.randrange(200) + rng.choice([b"", b"\r\n", trap, deep]) for _ in range(150)]
    (tmp_path / "w").mkdir()
    want = []
    for k in range(3):
        rng.shuffle(payloads)
        data, at = b"", []
        for p in payloads:
            at.append(len(data))
            data += _record(p)
        name = f"{k}.warc" + ".gz" * packed
        (tmp_path / "w" / name).write_bytes(b"".join(gzip.compress(data[x:y]) for x, y in zip(at, [*at[1:], None])) if packed else data)
        want += [(name, x, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()) for x, p in zip(at, payloads)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = read_warc(spark, f"{tmp_path}/w", payloads=True, at_once=40).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.archive.rsplit("/", 1)[-1], r.offset, r.payload_bytes, r.payload_digest) for r in got) == sorted(want)
    assert all(hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest) for r in got)


def test_broken_chain(spark, tmp_path):
    record = _record(b"ab")
    for name, data, whole in (("a", record * 9, 9), ("b", record + record[:-3], 1), ("c", record + record[:-1], 1), ("d", b"x" + record, 0), ("e", record + _record(b"abc", length=2) + record, 1)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
        if whole == 9:
            assert read_warc(spark, f"{tmp_path}/{name}").count() == 9
        else:
            with pytest.raises(ValueError, match="breaks off"):
                read_warc(spark, f"{tmp_path}/{name}")
        assert read_warc(spark, f"{tmp_path}/{name}", strict=False).count() == whole


def test_classifiers(spark, empty):
    rng = random.Random(1)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(30))
    en, fr = ["the", "ing", "er"], ["eau", "ou", "qué"]
    rows = [(i, make([en, fr][i % 2]), ["en", "fr"][i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id < 80"))
    odd = spark.createDataFrame([(900, None, None), (901, "", None), (902, "123 !!", "en")], df.schema)
    got = {r.doc_id: r for r in language_id.identify(df.union(odd), model, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == t for i, _, t in rows) and all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert language_id.fit(df.where("lang is null")) is None
    assert {r.lang_pred for r in language_id.identify(df, None, ["doc_id"]).collect()} == {"und"}

    marked = spark.createDataFrame([(i % 2, make(en) + (" !! $$$ " * 9 if i % 2 else "")) for i in range(80)], "label int, text string")
    quality = quality_knn.fit(marked)
    scored = quality_knn.score_quality(spark.createDataFrame([(0, make(en)), (1, make(en) + " !! $$$ " * 9), (2, None), (3, "")], "doc_id long, text string"), quality, ["doc_id"]).collect()
    assert {r.doc_id: r.score > 0.7 for r in scored if r.doc_id < 2} == {0: False, 1: True} and all(0 <= r.score <= 1 for r in scored)
    assert quality_knn.fit(marked.limit(0)) is None and quality_knn.score_quality(empty, None, ["doc_id"]).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(4)
    en = ["the", "ing", "er", "on", "ti", "sh"]
    make = lambda extra="": " ".join(["".join(rng.choice(en) for _ in range(rng.randint(1, 3))) for _ in range(25)] + ([extra] if extra else []))
    train = [(1, make(rng.choice(["idiot", "moron"]))) for _ in range(60)] + [(0, make()) for _ in range(120)]
    df = spark.createDataFrame(train, "label int, text string")
    model = toxicity.fit(df, toxicity.char_model(df.union(spark.createDataFrame([(0, "idiot moron " * 50)], df.schema))))
    cases = ["1d10t", "i d i o t", "m.o.r.o.n", "moooron", "M0R0N", "(idiot)"]
    test = [(i, make(c)) for i, c in enumerate(cases)] + [(100 + i, make()) for i in range(20)] + [(200, None), (201, "")]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(test, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert all(got[i] >= 0.3 for i in range(len(cases))), got
    assert all(got[i] < 0.3 for i in got if i >= 100), got
    assert toxicity.fit(df.limit(0), toxicity.char_model(empty)) is None
    assert {r.score for r in toxicity.score_toxicity(df.selectExpr("1 as doc_id", "text"), None, ["doc_id"]).collect()} == {0.0}


def test_toxic_sample_keeps_texts_that_share_words(spark):
    rng = random.Random(6)
    text = lambda: " ".join(["you", "are", "the"] + [f"w{rng.randrange(10_000)}" for _ in range(40)])
    toxic, clean = [text() for _ in range(20)], [text() for _ in range(30)]
    near = [toxic[0] + " tail", toxic[0] + " end"]
    df = spark.createDataFrame([(1, t) for t in toxic + near] + [(0, t) for t in [*clean, toxic[1]]], "label int, text string")
    got = {(r.label, r.text) for r in toxicity._without_near_copies(df).collect()}
    assert len(got) == 51 and {(0, t) for t in [*clean, toxic[1]]} | {(1, t) for t in toxic[1:]} <= got


def test_long_suspects():
    prose = "you are a complete idiot and the moron of them all said so you are not the one that we all like and they are not here " * 40
    codes = [int(toxicity._LOWER[ord(c)]) for c in prose]
    model = toxicity.CharModel.of(Counter((0 if not b else int(a)) << 16 | int(b) << 8 | int(c) for a, b, c in zip(codes, codes[1:], codes[2:])))
    plain = [f"{a}{b}" for a in ("stone", "water", "green", "light") for b in ("wood", "field", "house", "side")]
    cases = [
        " ".join("you are a complete idiot and".replace(" ", "")),
        " ".join("you are a complete idiot and the moron of them all".replace(" ", "")) * 5,
        "foo,bar,1d10t,baz",
        ",".join([*plain[:5], "1d10t", *plain[5:7]]),
        "http://example.org/" + "/".join(plain[:4]) + "/1d10t/index",
        ",".join([*plain, *plain, "1d10t", *plain]),
        ",".join([*plain, *plain, "i.d.i.o.t", *plain]),
        "x" * 100_000 + ",1d10t," + "y" * 1000,
    ]
    for case in cases:
        assert " idiot " in toxicity.restored(f"so {case} then", model, {}), case[:80]


def test_disguises_in_short_and_long_places():
    """Five disguises of many words are read alike in a short token and inside an address, a list or unparted text of hundreds of signs."""
    docs = open_documents("/root/testdata/sf0.01")
    codes = Counter()
    for text in docs:
        points = toxicity._SYMBOL[toxicity.letters_of(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))].tolist()
        codes.update((0 if not b else a) << 16 | b << 8 | c for a, b, c in zip(points, points[1:], points[2:]) if b or c)
    model = toxicity.CharModel.of(codes)
    common = Counter(w for t in docs for w in re.findall(r"[a-z]{6,9}", t))
    chosen = [w for w, _ in common.most_common(200) if toxicity.squeezed(w) == w][:12]
    assert len(chosen) == 12
    filler = [w for w, _ in common.most_common(400)[200:]]
    leet = {"a": "4", "e": "3", "o": "0", "i": "1", "s": "5", "t": "7"}
    forms = {
        "dots": lambda w: ".".join(w), "star": lambda w: f"{w[:2]}*{w[2:]}", "leet": lambda w: "".join(leet.get(c, c) for c in w),
        "repeats": lambda w: "".join(c * (4 if k == 2 else 1) for k, c in enumerate(w)), "dashes": lambda w: "-".join(w),
    }
    places = {
        "address": lambda x: "http://example.org/" + "/".join(filler[:20]) + f"/{x}/" + "/".join(filler[20:40]),
        "list": lambda x: ",".join([*filler[:30], x, *filler[30:60]]),
        "underscores": lambda x: "_".join([*filler[:25], x, *filler[25:50]]),
    }
    for name, form in forms.items():
        short = [f" {w} " in toxicity.restored(f"so {form(w)} then", model, {}) for w in chosen]
        assert sum(short) >= 8, (name, short)
        for place, put in places.items():
            long = [f" {w} " in toxicity.restored(f"so {put(form(w))} then", model, {}) for w in chosen]
            assert len(put("")) > 240 and all(b for a, b in zip(short, long) if a), (name, place, short, long)


def test_letters_beyond_latin1(spark):
    model = toxicity.CharModel.of(Counter())
    assert " idiot " in toxicity.restored("you \u201cidiot\u201d\u2026", model, {}) and " idiot " in toxicity.restored("idiot\U0001f600", model, {})
    got = toxicity.restored("Дурак ΛΌΓΟΣ 中文 हिन्दी 𠀀", model, {})
    assert " дурак " in got and " λόγοσ " in got and " 中文 " in got and " हिन्दी " in got and " 𠀀 " in got
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("бвгджзклмнпрст") for _ in range(5))
    text = lambda extra: " ".join([word() for _ in range(25)] + [extra])
    df = spark.createDataFrame([(1, text("дурак")) for _ in range(40)] + [(0, text(word())) for _ in range(80)], "label int, text string")
    fitted = toxicity.fit(df, toxicity.char_model(df))
    test = spark.createDataFrame([(0, text(word())), (1, text("«дурак»")), (2, text("ДУРАК"))], "doc_id long, text string")
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.score_toxicity(test, fitted, ["doc_id"]).collect()}
    assert got == {0: False, 1: True, 2: True}


def test_suspects():
    text = "x é" * 1000 + " 1d10t"
    import numpy as np

    ranges = toxicity.suspect_ranges(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    assert any(text[a:b].endswith("1d10t") for a, b in ranges)
    assert F is not None
