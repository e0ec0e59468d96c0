"""Text statistics, base rules, and robust multivariate outliers.

Words are ``[^\\x20\\x09-\\x0D]+``.  One pass over whole texts counts words
and their code points, symbols ``[#*$%&|<>]``, lines that repeat an earlier
line, and words in five-word windows found twice or more in the text; words
and windows are compared by 64-bit hash.  A text fails the base rules with
fewer than ten words or over a fifth of its words in repeated windows.

The statistics are then transformed (square roots of damped shares, log of
mean word length) into vectors.  For each language and source the minimum
covariance determinant estimate is sought over all its rows: the mean and
covariance of the ``support`` share of rows whose covariance has the least
determinant.  Three starts are made from medians and quartiles: the diagonal
of the variances, the correlation of hyperbolic tangents, and that of spatial
signs.  From each, concentration steps keep the nearest rows by Mahalanobis
distance and estimate anew until no determinant falls further; the start with
the least determinant stays.  The covariance is scaled to be consistent for
normal data, and regularised by the square of ``floor``, the smallest standard
deviation that is told apart, so that a statistic that is constant in clean
text does not reject a trace of it.  A row is rejected when its squared distance exceeds
the chi-square quantile of ``1 - tail``.

Distances are ranked by fine histograms, so every step is an aggregation with
partial sums and no group is held in a task; models, whose number is counted,
are broadcast up to ``broadcast_models`` and joined beyond.  An estimate needs
more than five rows for each dimension: a group with fewer takes the
estimate of all rows of its language, and that of the whole table where the
language has too few.  Every row gets a verdict.

Defined results: a null or wordless text has zero counts and fails; null
language or source is a value like any other; repeated rows count each; equal
distances fall on one side of a cut together; a very long text is counted
whole; an empty table gives an empty result.  Extra columns are not read, and
``passing`` carries them whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed, fresh, row_key
from .textnp import SPACE, Words, blocks, grams, grouped, spans, string_buffer, within

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VECTOR = ["v_length", "v_symbols", "v_lines", "v_repeats", "v_upper", "v_digits"]
#: Smallest standard deviation of each statistic.
FLOOR = np.array([0.06, 0.04, 0.12, 0.12, 0.08, 0.2])
#: Words that damp a share in a short text.
DAMP = 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries whose (doc, hash) pair stands elsewhere too, and the first of each pair."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.zeros(len(h), dtype=bool)
    if len(h) > 1:
        a, b = order[1:], order[:-1]
        same[1:] = (h[a] == h[b]) & (doc[a] == doc[b])
    later, both = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    later[order[same]] = True
    both[order[same]] = True
    both[order[:-1][same[1:]]] = True
    return np.stack([later, both])


def statistics(buf: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The counts of a block of documents."""
    w = Words(buf, offsets)
    n, k = len(offsets) - 1, len(w)
    per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    out = {"n_words": w.counts, "n_symbols": per_doc(_SYMBOL[buf]), "n_upper": per_doc(_UPPER[buf]), "n_digits": per_doc(_DIGIT[buf])}
    out["word_chars"] = per_doc(~SPACE[buf] & ((buf & 0xC0) != 0x80))

    edge = np.union1d(np.flatnonzero(buf == 10), offsets)
    start, end = edge[:-1], edge[1:]
    start = start + (buf[start] == 10) * ~np.isin(start, offsets) if len(start) else start
    first_nl = np.isin(start, offsets) & (buf[np.minimum(start, max(len(buf) - 1, 0))] == 10) if len(start) else np.zeros(0, dtype=bool)
    keep = (np.searchsorted(w.start, end) > np.searchsorted(w.start, start)) & ~first_nl
    start, end = start[keep], end[keep]
    line_doc = np.searchsorted(offsets, start, side="right") - 1
    later = _repeated(spans(buf, start, end), line_doc)[0]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc, weights=later, minlength=n).astype(np.int64)

    covered = np.zeros(k + 1, dtype=np.int64)
    if k >= window:
        ok = np.flatnonzero(within(w.first, window, k))
        g, doc = grams(w.hashes(), window)[ok], w.doc()[ok]
        # a first pass by hash alone leaves only windows that may repeat
        s = np.sort(g)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            some = twice[np.minimum(np.searchsorted(twice, g), len(twice) - 1)] == g
            ok, g, doc = ok[some], g[some], doc[some]
            at = ok[_repeated(g, doc)[1]]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + window, -1)
    out["n_repeat_words"] = np.bincount(w.doc(), weights=np.cumsum(covered)[:k] > 0, minlength=n).astype(np.int64)
    return out


_STATS = [("doc_id", None), ("key", pa.int64()), ("g0", pa.int64()), ("g1", pa.int64()), *((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in VECTOR)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = string_buffer(batch.column(4))
        for i, j in blocks(offsets):
            s = statistics(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            share = lambda a, b, damp: np.sqrt(s[a] / (s[b] + damp))  # noqa: E731, B023
            vector = [
                np.log((s["word_chars"] + 5 * DAMP) / (s["n_words"] + DAMP)),
                share("n_symbols", "word_chars", 5 * DAMP),
                share("n_dup_lines", "n_lines", DAMP / 4),
                share("n_repeat_words", "n_words", DAMP),
                share("n_upper", "word_chars", 5 * DAMP),
                share("n_digits", "word_chars", 5 * DAMP),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(4)), *(pa.array(s[c].astype(np.int64)) for c in COUNTS), *(pa.array(np.round(v, 9)) for v in vector)], [n for n, _ in _STATS])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, key, g0, g1, the counts, the vector) for each row of ``docs(doc_id, text, lang, source)``.

    ``key`` is the row's, ``g0`` names its language and source, ``g1`` its language.
    """
    rows = docs.select("doc_id", row_key("doc_id", "text", "lang", "source").alias("key"), row_key("lang", "source").alias("g0"), row_key("lang").alias("g1"), "text")
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, g0 long, g1 long, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in VECTOR])
    return rows.mapInArrow(_measure, ddl)


def _gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1.0 / a
    n = a
    while abs(term) > 1e-17 * abs(total) and n < a + 10_000:
        n += 1
        term *= x / n
        total += term
    return 0.0 if x <= 0 else min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_square_share(x: float, k: int) -> float:
    """P(chi-square of k degrees <= x)."""
    return _gamma_share(k / 2, x / 2)


def chi_square_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_share(high, k) < share:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, k) < share else (low, mid)
    return high


def consistency(support: float, k: int) -> float:
    """What the covariance of the nearest ``support`` share of normal rows is scaled by."""
    return 1.0 if support >= 1 else support / chi_square_share(chi_square_quantile(support, k), k + 2)


_MODEL = "g long, start int, mean array<double>, inv array<double>, logdet double"


def _model_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["g", "start", "mean", "inv", "logdet"])


def _one(g: int, start: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    return g, start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _symmetric(r: dict, name: str, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = r[f"{name}{i}_{j}"] or 0.0
    return out


def _from_moments(floor: np.ndarray, scale: float):
    """Models of the rows that a concentration step kept."""
    p = len(floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mean = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
                out.append(_one(r["g"], r["start"], mean, scale * (_symmetric(r, "c", p) / r["n"] - np.outer(mean, mean)) + np.diag(floor**2)))
            yield _model_batch(out)

    return run


def _from_scores(floor: np.ndarray):
    """Three first models of each group: variances alone, correlation of tangents, correlation of spatial signs."""
    p = len(floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mean, dev, n = np.array(r["mid"]), np.array(r["dev"]), r["n"]
                t = np.array([r[f"t{i}"] for i in range(p)]) / n
                tangents = _symmetric(r, "tt", p) / n - np.outer(t, t) + 1e-6 * np.eye(p)
                tangents /= np.sqrt(np.outer(np.diag(tangents), np.diag(tangents)))
                signs = p * _symmetric(r, "uu", p) / n
                for k, shape in enumerate((np.eye(p), tangents, signs)):
                    out.append(_one(r["g"], k, mean, np.outer(dev, dev) * shape + np.diag(floor**2)))
            yield _model_batch(out)

    return run


def _products(columns: list, name: str) -> list:
    p = len(columns)
    return [F.sum(columns[i] * columns[j]).alias(f"{name}{i}_{j}") for i in range(p) for j in range(i, p)]


def _middles(rows: DataFrame, floor: np.ndarray) -> DataFrame:
    """(g, mid, dev): medians, and deviations from quartiles, by histograms of 1/512."""
    each = rows.select("g", F.posexplode(F.array(*VECTOR)).alias("i", "x"))
    bins = each.groupBy("g", "i", F.floor(F.col("x") * 512).alias("b")).count()
    line = Window.partitionBy("g", "i")
    bins = bins.withColumn("below", F.sum("count").over(line.orderBy("b"))).withColumn("n", F.sum("count").over(line))
    at = lambda q: F.min(F.when(F.col("below") >= q * F.col("n"), F.col("b")))
    q = bins.groupBy("g", "i").agg(((at(0.5) + 0.5) / 512).alias("mid"), ((at(0.75) - at(0.25)) / 512 / 1.349).alias("dev"))
    q = q.withColumn("floor", F.element_at(F.array(*[F.lit(float(x)) for x in floor]), F.col("i") + 1))
    q = q.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "mid", F.hypot("dev", "floor").alias("dev")))).alias("all"))
    return q.select("g", F.transform("all", lambda x: x["mid"]).alias("mid"), F.transform("all", lambda x: x["dev"]).alias("dev"))


def _near(df: DataFrame, small: bool) -> DataFrame:
    """``df``, for a join with rows: broadcast if it was counted to be small."""
    return F.broadcast(df) if small else df


def _first_models(rows: DataFrame, floor: np.ndarray, small: bool) -> DataFrame:
    p = len(floor)
    middles = checkpointed(_middles(rows, floor))
    z = rows.join(_near(middles, small), "g")
    z = z.select("g", "mid", "dev", *[((F.col(VECTOR[i]) - F.get("mid", F.lit(i))) / F.get("dev", F.lit(i))).alias(f"z{i}") for i in range(p)])
    size = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)]))
    z = z.withColumn("size", F.greatest(size, F.lit(1e-9)))
    z = z.select("g", "mid", "dev", *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(p)], *[(F.col(f"z{i}") / F.col("size")).alias(f"u{i}") for i in range(p)])
    t, u = ([F.col(f"{c}{i}") for i in range(p)] for c in "tu")
    sums = z.groupBy("g").agg(F.first("mid").alias("mid"), F.first("dev").alias("dev"), F.count("*").alias("n"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(p)], *_products(t, "tt"), *_products(u, "uu"))
    return checkpointed(sums.mapInArrow(_from_scores(floor), _MODEL).withColumn("core", F.lit(False)))


def _distance(p: int):
    d = [F.col(VECTOR[i]) - F.get("mean", F.lit(i)) for i in range(p)]
    terms = [F.get("inv", F.lit(i * p + j)) * d[i] * d[j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, terms))


def covariance_determinants(rows: DataFrame, support: float = 0.75, floor: np.ndarray = FLOOR, broadcast_models: int = 50_000) -> DataFrame:
    """(g, mean, inv, logdet): the estimate of each group of ``rows(g, the vector)`` with the least determinant.

    A start is done when its determinant falls by no more than a
    ten-thousandth; each step works on the starts that are not.
    """
    p = len(VECTOR)
    small = rows.select("g").distinct().limit(broadcast_models + 1).count() <= broadcast_models
    scale, done = consistency(support, p), None
    model = _first_models(rows, floor, small)
    while True:
        near = rows.join(_near(model, small), "g").withColumn("d2", _distance(p)).withColumn("b", F.floor(F.log2(F.col("d2") + 1e-9) * 64).cast("long"))
        bins = near.groupBy("g", "start", "b").count()
        line = Window.partitionBy("g", "start")
        bins = bins.withColumn("below", F.sum("count").over(line.orderBy("b"))).withColumn("n", F.sum("count").over(line))
        cut = bins.groupBy("g", "start").agg(F.min(F.when(F.col("below") >= support * F.col("n"), F.col("b"))).alias("inner"))
        core = near.join(_near(cut, small), ["g", "start"]).where(F.col("b") <= F.col("inner"))
        moments = core.groupBy("g", "start").agg(F.count("*").alias("n"), *[F.sum(VECTOR[i]).alias(f"s{i}") for i in range(p)], *_products([F.col(v) for v in VECTOR], "c"))
        step = moments.mapInArrow(_from_moments(floor, scale), _MODEL)
        before = model.select("g", "start", F.col("mean").alias("m"), F.col("inv").alias("v"), F.col("logdet").alias("before"), F.col("core").alias("again"))
        step = step.join(before, ["g", "start"])
        # a first model is of no core, so its determinant is not compared
        fell = ~F.col("again") | (F.col("before") - F.col("logdet") > 1e-4)
        worse = F.col("again") & (F.col("logdet") > F.col("before"))
        kept = [F.when(worse, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in (("mean", "m"), ("inv", "v"), ("logdet", "before"))]
        step = checkpointed(step.select("g", "start", *kept, F.lit(True).alias("core"), fell.alias("active")))
        ended = step.where("not active").drop("active")
        done = ended if done is None else done.union(ended)
        model = step.where("active").drop("active")
        if model.isEmpty():
            return done.groupBy("g").agg(F.min_by(F.struct("mean", "inv", "logdet"), F.struct("logdet", "start")).alias("m")).select("g", "m.*")


def outliers(rows: DataFrame, tail: float = 1e-3, min_rows: int = 5 * len(VECTOR) + 1, broadcast_models: int = 50_000, **options) -> DataFrame:
    """``rows(g0, g1, the vector, ...)`` with d2 and rejected."""
    p = len(VECTOR)
    size = rows.groupBy("g0", "g1").count()
    size = size.withColumn("n1", F.sum("count").over(Window.partitionBy("g1")))
    level = F.when(F.col("count") >= min_rows, 0).when(F.col("n1") >= min_rows, 1).otherwise(2)
    g = F.when(F.col("level") == 0, F.col("g0")).when(F.col("level") == 1, F.col("g1")).otherwise(F.lit(0))
    pooled = F.max((F.col("level") == 1).cast("int")).over(Window.partitionBy("g1"))
    groups = checkpointed(size.withColumn("level", level).select("g0", "level", g.alias("g"), pooled.alias("pooled")))
    whole = not groups.where("level = 2").isEmpty()
    small = groups.limit(broadcast_models + 1).count() <= broadcast_models
    placed = rows.join(_near(groups, small), "g0")
    # a row is learned from in its own group, and in the pools that smaller groups take their estimate from
    pools = F.array_compact(F.array(F.when(F.col("level") == 0, F.col("g0")), F.when(F.col("pooled") == 1, F.col("g1")), F.when(F.lit(whole), F.lit(0).cast("long"))))
    learned = checkpointed(placed.select(F.explode(pools).alias("g"), *VECTOR))
    model = checkpointed(covariance_determinants(learned, broadcast_models=broadcast_models, **options))
    judged = placed.join(_near(model.select("g", "mean", "inv"), small), "g").withColumn("d2", _distance(p))
    return judged.withColumn("rejected", F.col("d2") > chi_square_quantile(1 - tail, p)).drop("g", "level", "pooled", "mean", "inv")


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, key, the counts, base_failed, d2, kept) for ``docs(doc_id, text, lang, source)``."""
    stats = checkpointed(measured(docs))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = outliers(stats, **options)
    return out.select("doc_id", "key", *COUNTS, failed.alias("base_failed"), "d2", (~failed & ~F.col("rejected")).alias("kept"))


def passing(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns stay."""
    key = fresh(docs, "key")
    kept = quality_rules(docs, **options).where("kept").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key("doc_id", "text", "lang", "source")).join(kept, key, "left_semi").drop(key)
