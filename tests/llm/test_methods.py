"""The corpus operators' methods, each against a plain version of itself; odd rows through every operator; the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus import SCHEMA, brute_components, shingle_set, words

import corpus_pipeline
from terragrain.llm import language_id, quality_knn, substring_dedup, suffixes, toxicity
from terragrain.llm.decontaminate import decontaminated, find_leaks
from terragrain.llm.features import FOLD, bounded_sample, presence
from terragrain.llm.line_dedup import deduplicated, line_dedup, repeated_runs
from terragrain.llm.mixing import mix
from terragrain.llm.ngram_join import ngram_components, one_of_each
from terragrain.llm.quality_rules import VECTOR, chi_square_quantile, consistency, covariance_determinants, measured, passing, quality_rules
from terragrain.llm.textnp import string_buffer


def lcp(x, y):
    return next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_suffix_array(spark, monkeypatch):
    """Order, LCP and later copies of sequences with runs of many lengths, in slices of forty rows."""
    monkeypatch.setattr(suffixes, "SLICE_ROWS", 40)
    rng = random.Random(3)
    base = [rng.randrange(6) for _ in range(70)]
    seqs = {}
    for r in range(14):
        if r % 3 == 0:
            x = base[: rng.randrange(1, 70)]
        elif r % 3 == 1:
            x = base[rng.randrange(60) :] + [rng.randrange(100, 10_000)]
        else:
            x = [rng.choice([0, 1, 2, 3, rng.randrange(50, 10**6)]) for _ in range(rng.randrange(40))]
        seqs[r * 7 - 20] = (rng.randrange(5), x)
    df = spark.createDataFrame([(r, o, x) for r, (o, x) in seqs.items()], "rid long, ord long, ids array<long>").repartition(3)
    often = Counter(v for _, x in seqs.values() for v in x)
    tail = {(r, i): x[i:] for r, (_, x) in seqs.items() for i in range(len(x)) if often[x[i]] > 1}
    got = sorted(map(tuple, suffixes.suffix_array(df).collect()))
    assert sorted((r, i) for _, r, i, _ in got) == sorted(tail)
    assert all(q[3] == lcp(tail[p[1], p[2]], tail[q[1], q[2]]) for p, q in itertools.pairwise(got))
    near = [x[3] for x in got] + [0]
    for k, (_, r, i, shared) in enumerate(got):
        assert max(lcp(tail[r, i], t) for s, t in tail.items() if s != (r, i)) == max(shared, near[k + 1])
    for depths in ([3], [1, 2, 3], [6]):
        want = {}
        for a, d in itertools.product(tail, depths):
            if any(lcp(tail[a], tail[b]) >= d and (seqs[b[0]][0], *b) < (seqs[a[0]][0], *a) for b in tail if b != a):
                want[a] = d
        assert {(r, i): n for r, i, n in map(tuple, suffixes.later_copies(df, depths).collect())} == want
    assert suffixes.suffix_array(df.limit(0)).count() == 0


def test_rows_without_ids(spark):
    """Of equal rows without a doc_id all but one are later copies; rows of one id are one document."""
    text = "\n".join(f"line number {k} of five" for k in range(5))
    rows = [(None, text, "a"), (None, text, "b"), (None, text, "c"), (None, "short", "a"), (None, "short", "b"), (9, text + "\nmore", "d"), (9, text + "\nmore", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, c0 string")
    got = sorted((r.doc_id is None, r.text) for r in deduplicated(df).collect())
    assert got == sorted([(True, "")] * 3 + [(True, "short")] * 2 + [(False, text + "\nmore")] * 2)
    alone = deduplicated(df.where("doc_id is null")).collect()
    assert sorted(r.text for r in alone) == ["", "", *[text], "short", "short"] and sorted(r.c0 for r in alone) == ["a", "a", "b", "b", "c"]


def test_repeated_runs(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd"), (3, "b\nc\ny"), (4, "a\nb\nc\nd")], "doc_id long, text string")
    got = sorted((r.i, r.lcp) for r in repeated_runs(df).collect())
    assert len(got) == 8 and max(n for _, n in got) == 3


def test_passages_and_automata():
    rng = random.Random(7)
    window = 5
    alphabet = [substring_dedup.Alphabet({bytes([k]): k for k in range(50)}), substring_dedup.Alphabet({bytes([k]): k for k in range(50)}, symbols=20)]
    assert [a.width for a in alphabet] == [1, 2]
    for trial in range(60):
        texts = {tuple(rng.randrange(4) * (trial % 3) + rng.randrange(3) for _ in range(rng.randrange(5, 14))) for _ in range(rng.randrange(1, 5))}
        counts = {t: rng.choice([1, 1, 2]) for t in texts}
        seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1) for _ in range(counts[t]))
        for a in alphabet:
            group = []
            for t in sorted(texts):
                p = substring_dedup.Piece(list(t))
                p.text, p.count = a.spell(list(t)), counts[t]
                group.append(p)
            found = substring_dedup.passages_of(group, window, a.width)
            for size in (3, 1000):
                cover = substring_dedup.Automata(found, size, a.width).covered([p.text for p in group])
                for t, got in zip(sorted(texts), cover):
                    want = np.zeros(len(t), dtype=bool)
                    for i in range(len(t) - window + 1):
                        if seen[t[i : i + window]] > 1:
                            want[i : i + window] = True
                    assert (got == want).all()


def test_what_automata_do_not_find_stays(monkeypatch):
    """The words to remove come from matches alone, and hashes that agree by chance confirm nothing."""
    piece = lambda ws: " ".join(ws).encode()
    a, b = piece(f"w{k}" for k in range(40)), piece([*(f"w{k}" for k in range(20)), *(f"v{k}" for k in range(20))])
    row = {"shard": 0, "phrases": bytes([4, 4]), "rids": np.array([1, 2, 3]).tobytes(), "places": np.array([0, 7, 9], dtype=np.int32).tobytes(), "counts": np.array([2, 1], dtype=np.int32).tobytes(), "sizes": np.array([len(a), len(b)], dtype=np.int32).tobytes(), "text": a + b}
    batch = pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("phrases", "rids", "places", "counts", "sizes", "text"))]))
    run = substring_dedup._locate(35, 8, 1, 1000)
    rids = [np.frombuffer(r["rids"], dtype=np.int64).tolist() for x in run(iter([batch])) for r in x.to_pylist()]
    assert rids == [[1, 2]]
    monkeypatch.setattr(substring_dedup.Automata, "covered", lambda self, texts: [np.zeros(len(t), dtype=bool) for t in texts])
    assert list(run(iter([batch]))) == []


def test_kernel_against_sets(spark):
    texts = ["the cat sat", "le chat noir", "THE CAT", "x", "", "ñandú über 12"]
    buf, offsets = string_buffer(pa.array(texts))
    x = presence(buf, offsets, (1, 2, 3), 13)
    folded = [bytes(FOLD[np.frombuffer(t.encode(), dtype=np.uint8)]) if t else b"" for t in texts]
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in folded]
    model = language_id.LanguageModel(["a"], x, np.zeros((len(texts) + 1, 1)), (1, 2, 3), 13)
    for i, j in itertools.product(range(len(texts)), repeat=2):
        want = len(grams[i] & grams[j]) / max(len(grams[i]), 1) ** 0.5 / max(len(grams[j]), 1) ** 0.5
        assert model.kernel(x)[i, j] == pytest.approx(want, abs=0.08)  # hashed to 13 bits


def test_many_languages(spark):
    """Every language with a labelled row is learned, however many there are; each by scores of a plain ridge regression."""
    rng = random.Random(2)
    tongue = {f"l{k:03d}": [f"{chr(97 + k % 26)}{chr(97 + (k * 7 + j) % 26)}{chr(97 + (k * 3 + j * j) % 26)}" for j in range(4)] + [f"{k:03d}x"] for k in range(120)}
    say = lambda k: " ".join(rng.choice(tongue[k]) for _ in range(40))
    train = spark.createDataFrame([(k, say(k)) for k in tongue for _ in range(4)], "lang string, text string")
    model = language_id.fit(train)
    assert len(model.languages) == 120
    test = spark.createDataFrame([(i, k, say(k), "x") for i, k in enumerate(tongue)], "doc_id long, lang string, text string, c0 string")
    got = {r.doc_id: r for r in language_id.identify(test, model, ["doc_id", "c0"]).collect()}
    assert sum(got[i].lang_pred == k for i, k in enumerate(tongue)) >= 118 and got[0].c0 == "x"
    rows = test.orderBy("doc_id").limit(5).collect()
    x = presence(*string_buffer(pa.array([r.text for r in rows])), model.orders, model.bits)
    plain = []
    for row in x:
        k = np.array([(row * m).sum() / max(row.sum(), 1) ** 0.5 / max(m.sum(), 1) ** 0.5 for m in model.landmarks])
        plain.append(k @ model.weights[:-1] + model.weights[-1])
    for r, s in zip(rows, plain):
        assert got[r.doc_id].lang_pred == model.languages[int(s.argmax())] and got[r.doc_id].score == pytest.approx(np.clip((s.max() + 1) / 2, 0, 1), abs=1e-4)


def test_bounded_sample(spark):
    df = spark.createDataFrame([("ab"[k % 2] if k < 900 else "rare", f"text {k % 700}") for k in range(903)], "label string, text string")
    got = bounded_sample(df, "label", 50).collect()
    assert Counter(r.label for r in got) == {"a": 50, "b": 50, "rare": 3} and len({(r.label, r.text) for r in got}) == 103
    assert bounded_sample(df.limit(0), "label", 5).count() == 0


def test_cosine_votes(spark):
    rng = random.Random(5)
    good, bad = ["river", "stone", "light", "green"], ["$$$", "WIN", "!!!", "click"]
    say = lambda of: " ".join(rng.choice(of) for _ in range(rng.randrange(12, 30)))
    train = [(k % 2, say(good if k % 2 else bad)) for k in range(60)]
    model = quality_knn.fit(spark.createDataFrame(train, "label int, text string"))
    texts = [say(good), say(bad), say(good + bad), "river", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_knn.score_quality(df, model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        if not text:
            assert got[i] == pytest.approx(model.mean, abs=1e-6)
            continue
        x = quality_knn.features(*string_buffer(pa.array([text])))
        z = ((x * model.idf) @ model.directions)[0]
        cos = sorted(((float(z @ v) / np.linalg.norm(z), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[: model.neighbours]
        vote = [np.exp(20 * (c - cos[0][0])) for c, _ in cos]
        assert got[i] == pytest.approx(sum(v * y for v, (_, y) in zip(vote, cos)) / sum(vote), abs=2e-3)


def test_viterbi_against_all_paths():
    rng = random.Random(11)
    prose = "the idiot said so and the moron said it too while all others stayed at home " * 5
    codes = [int(toxicity._SYMBOL[toxicity.letters_of(ord(c))]) for c in prose]
    counts = Counter((0 if not b else a) << 16 | b << 8 | c for a, b, c in zip(codes, codes[1:], codes[2:]))
    model = toxicity.CharModel.of(counts)
    symbol = lambda c: int(toxicity._SYMBOL[toxicity.letters_of(ord(c))])

    def cost(path):
        total, a, b = 0.0, 0, 0
        for letter, extra in path:
            total += extra
            if letter == " ":
                total += model.cost(a, b, 0) if b else 0.0
                a = b = 0
            elif letter:
                total += model.cost(a, b, symbol(letter))
                a, b = b, symbol(letter)
        return total + model.cost(a, b, 0)

    for parted in (False, True):
        for _ in range(40):
            suspect = "".join(rng.choice("1d0t!i.m-oo7 ") for _ in range(rng.randrange(1, 8)))
            ways = toxicity.lattice(suspect, parted)
            best = min(cost(p) for p in itertools.product(*ways))
            got = toxicity.decode(suspect, model, parted)
            same = [cost(p) for p in itertools.product(*ways) if "".join(x for x, _ in p) == got]
            assert same and min(same) == pytest.approx(best)


def plain_apportionment(votes, seats):
    """Seats one by one to the highest quotient votes / (2 k + 1), the lower key on ties."""
    got = dict.fromkeys(votes, 0)
    for _ in range(seats if sum(votes.values()) else 0):
        got[min(votes, key=lambda k: (-votes[k] / (2 * got[k] + 1), k))] += 1
    return got


def test_mix_against_plain_apportionment(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 17, 40, 90])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, shard_docs=20).collect()
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    size, docs = Counter(), Counter()
    for r in got:
        size[r.source] += r.size
        docs[r.source] += 1
    target = {r.source: r.target for r in got}
    blocks = plain_apportionment({k: target[s] for k, s in enumerate(names)}, sum(size.values()) // 16)
    by = defaultdict(list)
    for r in got:
        draw = hashlib.md5(f"mix|{r.doc_id}|{r.size}".encode()).hexdigest()
        assert r.shard == int(draw[:8], 16) % -(-docs[r.source] // 20)
        by[r.source, r.shard].append((draw, r.doc_id, r.size, r.quota, r.taken))
    for k, s in enumerate(names):
        cells = {shard: sum(x[2] for x in line) for (of, shard), line in by.items() if of == s}
        quota = plain_apportionment(cells, blocks[k])
        for shard, cell in cells.items():
            words_ = quota[shard] * 16
            assert {x[3] for x in by[s, shard]} == {words_}
            rounds = min(3, words_ // cell) if cell else 0
            rest = words_ - rounds * cell if rounds < 3 else 0
            for _, _, n, _, taken in sorted(by[s, shard]):
                part = max(0, min(n, rest))
                rest -= part
                assert taken == rounds * n + part


def plain_determinant(x, floor, support=0.75):
    """The least determinant of concentration from three starts, held in memory."""
    p, h = x.shape[1], int(np.ceil(support * len(x)))
    mid = np.median(x, axis=0)
    dev = np.hypot(np.subtract(*np.percentile(x, [75, 25], axis=0)) / 1.349, floor)
    z = (x - mid) / dev
    t = np.cov(np.tanh(z).T, bias=True) + 1e-6 * np.eye(p)
    u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    best = None
    for shape in (np.eye(p), t / np.sqrt(np.outer(np.diag(t), np.diag(t))), p * u.T @ u / len(x)):
        mean, cov, before = mid, np.outer(dev, dev) * shape + np.diag(floor**2), np.inf
        while True:
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            core = x[np.argsort(d2, kind="stable")[:h]]
            mean, cov = core.mean(axis=0), consistency(support, p) * np.cov(core.T, bias=True) + np.diag(floor**2)
            now = np.linalg.slogdet(cov)[1]
            if before - now < 1e-4:
                break
            before = now
        best = min(best or (np.inf,), (now, mean, cov), key=lambda b: b[0])
    return best


def make_groups():
    rng = random.Random(2)
    text = lambda of, marks: " ".join("".join(rng.choice(of) for _ in range(rng.randint(2, 8))) + marks for _ in range(rng.randint(30, 80)))
    rows = []
    for lang, source, of, n in (("en", "s", "abcdefg", 150), ("en", "t", "ABCdefg", 90), ("en", "few", "abcdefg", 8), ("fr", "s", "abcdefghij", 60), (None, None, "xyz", 5)):
        rows += [(len(rows) + k, text(of, ""), lang, source) for k in range(n)]
        rows += [(len(rows) + 10_000 + k, text(of, rng.choice(["***", "$#"])), lang, source) for k in range(max(1, n // 12))]
    return rows


def test_kept_against_plain_estimates(spark):
    """Verdicts of several groups, small ones by their language or all rows."""
    rows = make_groups()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    stats = {r.doc_id: np.array([r[v] for v in VECTOR]) for r in measured(df).collect()}
    from terragrain.llm.quality_rules import FLOOR

    of = defaultdict(list)
    for i, _, lang, source in rows:
        of[lang, source].append(i)
    cut = chi_square_quantile(1 - 1e-3, len(VECTOR))
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    near = 0
    for (lang, source), ids in of.items():
        pool = ids
        if len(pool) < 31:
            pool = [i for (x, _), ids_ in of.items() if x == lang for i in ids_]
        if len(pool) < 31:
            pool = [i for ids_ in of.values() for i in ids_]
        _, mean, cov = plain_determinant(np.array([stats[i] for i in pool]), FLOOR)
        for i in ids:
            d2 = float((stats[i] - mean) @ np.linalg.inv(cov) @ (stats[i] - mean))
            if abs(np.log(d2 / cut)) < 0.3:
                near += 1  # medians and cuts come from fine bins
            else:
                assert (got[i].d2 > cut) == (d2 > cut), (lang, source, d2, got[i].d2)
    assert near < 12 and not any(got[i].kept for i, _, lang, _ in rows if i >= 10_000 and lang) and sum(got[i].kept for i in got if i < 10_000) > 280


def test_determinant_of_a_hot_group(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0.5, 0.05, (300, len(VECTOR))), rng.normal(1.5, 0.02, (60, len(VECTOR)))])
    from terragrain.llm.quality_rules import FLOOR

    df = spark.createDataFrame([(7, *map(float, r)) for r in x], "g long, " + ", ".join(f"{v} double" for v in VECTOR))
    got = covariance_determinants(df).collect()
    joined = covariance_determinants(df, broadcast_models=0).collect()
    assert len(got) == 1 and got[0].logdet == pytest.approx(joined[0].logdet)
    assert got[0].logdet == pytest.approx(plain_determinant(x, FLOOR)[0], abs=0.05)


def test_long_items(spark):
    """Items of many shingles need several hits, and are found with just enough of their text."""
    rng = random.Random(3)
    word = lambda: f"q{rng.randrange(5000)}"
    items, docs = [], []
    for i, n in enumerate((6, 9, 20, 60, 200)):
        item = [word() for _ in range(n)]
        items.append((i, " ".join(item)))
        for share in (1.0, 0.8, 0.7):
            keep = int(n * share)
            docs.append((len(docs), " ".join([word() for _ in range(50)] + item[:keep] + [word() for _ in range(50)])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = {(i, j) for i, t in docs for j, u in items if 100 * len(grams(t) & grams(u)) >= 75 * len(grams(u))}
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, b).collect()} == want == {(r.doc_id, r.item_id) for r in find_leaks(d, b, broadcast_bytes=0).collect()}
    assert len(want) >= 6


def odd_rows():
    rng = random.Random(8)
    long_ = "\n".join(" ".join(f"w{rng.randrange(9000)}" for _ in range(30)) for _ in range(32_000))  # over one block of 4 MB
    rows = [(1, long_, "en", "s1"), (2, "short one", "en", "s1"), (2, "short one", "en", "s1"), (3, None, None, None), (None, "", "fr", "s2"), (None, None, None, None), (4, long_, "en", "s1"), (5, "a b c d e f g h i j", "fr", "s2")]
    return [(*r, None, 1, 2, "x", "y", 3, True) for r in rows]


def test_very_long_texts_and_odd_rows(spark):
    rows = odd_rows()
    assert len(rows[0][1]) > 4 << 20
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    sizes = Counter((r[0], len(words(r[1]))) for r in rows)
    assert Counter((r.doc_id, r.n_words) for r in substring_dedup.substring_dedup(df).select("doc_id", "n_words").collect()) == sizes
    assert {r.n_removed for r in substring_dedup.substring_dedup(df).where("doc_id in (1, 4)").collect()} == {len(words(rows[0][1]))}
    assert Counter((r.doc_id, r.n_words) for r in quality_rules(df).collect()) == sizes
    assert Counter((r.doc_id, r.size) for r in mix(df).collect()) == sizes
    comp = {(r.doc_id, r.component_id, r.n_shingles) for r in ngram_components(df).collect()}
    assert (4, 1, len(shingle_set(rows[0][1]))) in comp
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup(df, ["doc_id"]).where("doc_id is not null").collect()}
    assert lines[1] == (32_000, 0) and lines[4] == (32_000, 32_000)
    part = " ".join(words(rows[0][1])[500_000:500_030])
    bench = spark.createDataFrame([(1, part), (1, part), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in find_leaks(df, bench).collect()} == {1, 4}
    assert {r.doc_id for r in decontaminated(df, bench).collect()} == {2, 3, None, 5} and one_of_each(df).count() < len(rows)
    model = language_id.fit(df.where("lang is not null"))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df, model, ["doc_id", "lang", "text"]).collect()}[1] == "en"
    marked = df.selectExpr("cast(doc_id % 2 as int) label", "text")
    assert quality_knn.score_quality(df, quality_knn.fit(marked), ["doc_id", "h"]).count() == len(rows)
    tox = toxicity.fit(marked, toxicity.char_model(df))
    assert toxicity.score_toxicity(df, tox, ["doc_id", "h"]).columns == ["doc_id", "h", "score"]
    assert toxicity.score_toxicity(df, tox, ["doc_id"]).count() == len(rows)


def test_clashing_names(spark):
    """Users' columns named like helpers pass through the stages."""
    names = ["__rid", "__nth", "__key", "__text", "c0", "rid", "label", "score"]
    df = spark.createDataFrame([(i, f"some words of document {i} that are long enough to stay in the set", "en", "s", 1, *["x"] * len(names)) for i in range(40)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    for out in (passing(df), deduplicated(df), one_of_each(df), decontaminated(df, bench)):
        assert out.columns == df.columns and all(r["__rid"] == r["__key"] == r["c0"] == "x" for r in out.limit(3).collect())


def plain_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        parts = t.split("\n")
        lines, gone = [k for k, x in enumerate(parts) if words(x)], set()
        for at in range(len(lines)):
            for n in (1, 2, 3):
                run = tuple(parts[k] for k in lines[at : at + n])
                if len(run) == n and (n == 3 or sum(len(words(x)) for x in run) > 50):
                    if run in seen:
                        gone |= set(lines[at : at + n])
                    seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(parts) if k not in gone)
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    block, leak = [line(8) for _ in range(4)], line(30)
    rows = []
    for i in range(140):
        body = [line(rng.randint(8, 14)) for _ in range(rng.randint(3, 6))]
        if i % 9 == 0:
            body[1:1] = block
        if i % 35 == 1:
            body.append(leak)
        rows.append((i, "\n".join(body), "en", "st"[i % 2]))
    rows += [(200 + k, rows[k][1].replace(" ", "  ", 1) + " end", "en", "s") for k in range(6)]
    rows += [(300, "too short", "en", "s"), (301, None, "en", "t"), (302, " ".join(["spam ham"] * 40), "en", "t"), (303, line(40).replace(" ", " ### "), "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, "never there at all in here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    from terragrain.llm.quality_rules import FLOOR

    stats = {r.doc_id: np.array([r[v] for v in VECTOR]) for r in measured(docs).collect()}
    cut, kept = chi_square_quantile(1 - 1e-3, len(VECTOR)), []
    for source in "st":
        ids = [i for i, _, _, s in rows if s == source]
        _, mean, cov = plain_determinant(np.array([stats[i] for i in ids]), FLOOR)
        kept += [i for i in ids if (stats[i] - mean) @ np.linalg.inv(cov) @ (stats[i] - mean) <= cut]

    def base(t):
        w = words(t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        return len(w) >= 10 and 100 * len(hit) <= 20 * len(w)

    left = {i: t for i, t, *_ in rows if i in set(kept) and base(t)}
    assert 130 < len(left) < len(rows) and not {300, 301, 302, 303} & set(left)
    left = plain_lines(left.items())
    first = {}
    for i, n, c in brute_components([(i, t) for i, t in left.items()]):
        first.setdefault(c if n else ("none", i), i)
    left = {i: left[i] for i in first.values()}
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    left = {i: t for i, t in left.items() if 100 * len(grams(split(t)) & grams(split(leak))) < 75 * len(grams(split(leak)))}
    assert set(got) == set(left) and len(left) <= 140
    source = {i: s for i, _, _, s in rows}
    size = Counter()
    for i, t in left.items():
        assert got[i].size == len(words(t))
        size[source[i]] += len(words(t))
    total = sum(size.values())
    goal = {"s": min(total * 5 / 7, 3 * size["s"])}
    goal["t"] = min(total - goal["s"], 3 * size["t"])
    taken = Counter()
    for i, r in got.items():
        assert r.target == pytest.approx(goal[source[i]]) and 0 <= r.taken <= 3 * r.size
        taken[source[i]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 32 for s in "st")


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert F is not None


def test_a_common_passage_makes_no_candidates(monkeypatch):
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 52, 30).astype(np.uint64)
    rows, of = [], []
    for k in range(400):
        if k % 10 == 9:  # near copy of an earlier row
            body = of[k - 6].copy()
            body[: rng.integers(1, 6)] += np.uint64(1)
        else:
            body = np.concatenate([common, rng.integers(1 << 30, 1 << 52, rng.integers(12, 120)).astype(np.uint64)])
        of.append(body)
        rows.append((k % 2, k, np.unique(body)[: toxicity.SKETCH]))
    rows += [(0, 400, np.zeros(0, dtype=np.uint64)), (0, 401, np.zeros(0, dtype=np.uint64)), (1, 402, rows[1][2])]
    want = []
    for r in sorted(rows, key=lambda r: r[:2]):
        if not any(r[0] == w[0] and toxicity._alike(r[2], w[2]) for w in want):
            want.append(r)
    calls, alike = [], toxicity._alike
    monkeypatch.setattr(toxicity, "_alike", lambda a, b: calls.append(1) or alike(a, b))
    assert toxicity._leaders(rows) == [r[:2] for r in want] and len(want) < 400
    assert len(calls) < len(rows)
    assert toxicity._leaders([]) == []
