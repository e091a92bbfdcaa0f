"""Quality rules: plain limits, and outliers of a document's statistics by minimum covariance determinant per language and source.

Each text gives counts, and from them a vector of transformed statistics (``STATISTICS``) in whole units of 1/1024. Per group the
centre and covariance of the densest part (``SHARE`` of its vectors) are estimated by concentration steps: distances from the last
estimate, the nearest vectors, their moments. Two starts, from medians (scales of medians; signs around medians), are taken side by side, and the one
that ends with the smaller determinant stays. A document whose Mahalanobis distance is beyond ``TAIL`` of a chi-squared law is rejected.

A step is one aggregation: moments are added up by group and by class of distance (classes are a sixteenth of an octave wide), and a running sum
over the classes of a group says where its share is reached. So what moves is rows for each group and class, never the vectors of a group. Vectors are
integers, so moments are exact and don't hang on the order in which tasks end.

Vectors that repeat count once: copies say nothing new about what is usual. To each covariance the square of ``noise`` is added, the
difference of a statistic that says nothing by itself, so that groups of near copies, and statistics that are 0 in all usual texts, don't make
everything else an outlier. A group of fewer than ``LEAST`` vectors is judged by its language, and a language of fewer by all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from palimpsest.llm.shared import Scratch, flat_utf8, slices

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: Name and noise of each statistic.
STATISTICS = (("word_length", 0.15), ("symbols", 0.3), ("upper", 0.12), ("marks", 0.3), ("digits", 0.12), ("repeated", 0.25), ("repeated_lines", 0.25))
UNIT, SHARE, TAIL, LEAST, STEPS, FILE_ROWS = 1024, 0.75, 1e-4, 100, 12, 50_000
P = len(STATISTICS)
_Q = [f"q{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in _PAIRS)]
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SHAPE = ["keys", "start", *(f"m{i}" for i in range(P)), *(f"w{i}_{j}" for i in range(P) for j in range(i + 1)), "logdet", "n"]
_ESTIMATE = "keys struct<lang:string,source:string>, start int, " + ", ".join(f"{c} double" for c in _SHAPE[2:-1]) + ", n long"

_WHITE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _MARK, _NEXT = (1 << k for k in range(7))


def _kinds() -> np.ndarray:
    """What each byte is: white space, capital, small letter, digit, symbol, other mark, or no first byte of a character."""
    out = np.zeros(256, np.uint8)
    for c in range(33, 127):
        out[c] = _MARK
    out[[9, 10, 11, 12, 13, 32]], out[65:91], out[97:123], out[48:58], out[list(SYMBOLS)], out[128:192] = _WHITE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _NEXT
    return out


_KIND = _kinds()


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a run of ``WINDOW`` words that is found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    size = 1
    while size < WINDOW:  # runs of 2, 4, 8 words, numbered by their halves
        distinct = int(ids.max()) + 1
        ids, found = pd.factorize(ids[:-size] * distinct + ids[size:])
        if len(found) == len(ids):
            return 0
        ids, size = ids.astype(np.int64), size * 2
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + WINDOW, minlength=n + 1)[: n + 1]
    return int((np.cumsum(edges) > 0).sum())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        flat, ends = flat_utf8(batch.column("text"))
        kinds = _KIND[flat]

        def count(of: int) -> np.ndarray:  # of each text
            return np.diff(np.concatenate([[0], np.cumsum(kinds & of != 0)])[ends])  # noqa: B023

        data = flat.tobytes()
        texts = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        own = []
        for text in texts:
            words, lines = text.split(), text.split(b"\n")
            full = [x for x in lines if x and not x.isspace()]
            own.append((len(words), len(full) - len(set(full)), repeated_words(words), len(full)))
        n, dup, repeated, lines = np.array(own, np.int64).reshape(-1, 4).T
        chars = np.diff(ends) - count(_NEXT) - count(_WHITE)
        symbols, upper, lower = count(_SYMBOL), count(_UPPER), count(_LOWER)
        some = np.maximum(n, 1)
        angle = lambda part, whole: np.arcsin(np.sqrt(part / np.maximum(whole, 1)))
        values = [np.log(np.maximum(chars, 1) / some), np.log1p(10 * symbols / some), angle(upper, upper + lower), np.log1p(10 * count(_MARK) / some), angle(count(_DIGIT), chars), angle(repeated, n), angle(dup, lines)]
        counts = dict(zip([x.split()[0] for x in COUNTS.split(", ")], (n, chars, symbols, dup, repeated), strict=True))
        vector = {q: np.round(UNIT * v).astype(np.int64) for q, v in zip(_Q, values, strict=True)}
        out = counts | vector
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(v) for v in out.values())], names=["doc_id", "lang", "source", *out])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source (null is ''; a value has '=' before it), the counts, base_failed, and the statistics q0 to q6 of every whole text."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key("lang"), key("source"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_measured, f"doc_id long, lang string, source string, {COUNTS}, " + ", ".join(f"{q} long" for q in _Q))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def chi2_below(x: float, freedom: int) -> float:
    """The chi-squared distribution function, by the series of the incomplete gamma function."""
    a, term, total, k = freedom / 2, 1.0, 1.0, 0
    while term > 1e-17 * total:
        k += 1
        term *= x / 2 / (a + k)
        total += term
    return math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1)) * total if x > 0 else 0.0


def chi2_at(share: float, freedom: int) -> float:
    """The point below which a chi-squared variable is with this probability."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, freedom) < share else (low, middle)
    return (low + high) / 2


#: What makes the covariance of the nearest SHARE of normal vectors that of all of them.
CONSISTENT = SHARE / chi2_below(chi2_at(SHARE, P), P + 2)
NOISE = np.diag([x**2 for _, x in STATISTICS])


def _solved(mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows w of a triangular matrix, for which the sum of (w (x - mean))^2 is the squared distance, and the log determinant."""
    full = CONSISTENT * spread + NOISE
    lower = np.linalg.cholesky(full)
    whole = np.linalg.inv(lower)
    return whole, 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups' moments to estimates."""
    for rows in batches:
        if not len(rows):
            continue
        n = rows["n"].to_numpy(float)
        mean = np.stack([rows[f"s{i}"].to_numpy(float) / n for i in range(P)], axis=1)
        spread = np.zeros((len(rows), P, P))
        for i, j in _PAIRS:  # exact as integers: n * sum(xy) - sum(x) * sum(y)
            exact = [int(a) * int(b) - int(c) * int(d) for a, b, c, d in zip(rows["n"], rows[f"s{i}_{j}"], rows[f"s{i}"], rows[f"s{j}"], strict=True)]
            spread[:, i, j] = spread[:, j, i] = np.array([v / (int(m) * int(m)) for v, m in zip(exact, rows["n"], strict=True)])
        whole, logdet = _solved(mean, spread / UNIT**2)
        out = {"keys": rows["keys"], "start": rows["start"]} | {f"m{i}": mean[:, i] / UNIT for i in range(P)}
        out |= {f"w{i}_{j}": whole[:, i, j] for i in range(P) for j in range(i + 1)} | {"logdet": logdet, "n": rows["n"]}
        yield pd.DataFrame(out)[_SHAPE]


def squared_distance() -> Column:
    """The squared Mahalanobis distance of the vector q from the estimate that was joined to it."""
    off = [F.col(q) / F.lit(float(UNIT)) - F.col(f"m{i}") for i, q in enumerate(_Q)]
    rows = [sum((F.col(f"w{i}_{j}") * off[j] for j in range(1, i + 1)), F.col(f"w{i}_0") * off[0]) for i in range(P)]
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def _levels(lang: Column, source: Column) -> Column:
    """The groups that a document belongs to, the narrowest first."""
    group = lambda a, b: F.struct(a.alias("lang"), b.alias("source"))
    return F.array(group(lang, source), group(lang, F.lit("*")), group(F.lit("*"), F.lit("*")))


def _starts(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """Per group two estimates: medians with the scales of medians, and medians with the moments of signs around them."""
    middle = lambda c, name: F.percentile(c, F.lit(0.5)).alias(name)  # noqa: E731  (of integers in a bounded range: memory is bounded)
    med = scratch.written(vectors.groupBy("keys").agg(*(middle(F.col(q), f"c{q}") for q in _Q)), "medians")
    # grouped by other keys than the joins', so that Spark may split these where a group is hot
    off = vectors.join(med, "keys").withColumns({q: F.col(q) - F.col(f"c{q}") for q in _Q})
    scales = off.groupBy("keys", *(f"c{q}" for q in _Q)).agg(*(middle(F.abs(q), f"d{q}") for q in _Q))
    scale = [F.greatest(1.4826 * F.col(f"d{q}") / UNIT, F.lit(x)) for q, (_, x) in zip(_Q, STATISTICS, strict=True)]
    scales = scratch.written(scales.select("keys", *(F.col(f"c{q}") for q in _Q), *(s.alias(f"d{q}") for s, q in zip(scale, _Q, strict=True))), "scales")
    # directions of scaled vectors, in whole units again
    unit = [(F.col(q) - F.col(f"c{q}")) / UNIT / F.col(f"d{q}") for q in _Q]
    long = F.sqrt(sum((u * u for u in unit[1:]), unit[0] * unit[0]))
    signs = vectors.join(scales, "keys").select("keys", *(F.coalesce(F.round(UNIT * F.try_divide(u, long)), F.lit(0)).cast("long").alias(q) for u, q in zip(unit, _Q, strict=True)))
    signs = signs.groupBy(F.struct("keys").alias("group")).agg(*_moments()).withColumn("keys", F.col("group.keys")).join(scales, "keys")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            centre = np.stack([rows[f"c{q}"].to_numpy(float) / UNIT for q in _Q], axis=1)
            own = np.stack([rows[f"d{q}"].to_numpy(float) for q in _Q], axis=1)
            spread = np.zeros((len(rows), P, P))
            for i, j in _PAIRS:
                spread[:, i, j] = spread[:, j, i] = rows[f"s{i}_{j}"].to_numpy(float) / rows["n"].to_numpy(float) / UNIT**2
            shape = P * spread * own[:, :, None] * own[:, None, :]
            for start, s in enumerate((np.einsum("ni,ij->nij", own**2, np.eye(P)), shape)):
                whole, logdet = _solved(centre, s)
                out = {"keys": rows["keys"], "start": start} | {f"m{i}": centre[:, i] for i in range(P)}
                out |= {f"w{i}_{j}": whole[:, i, j] for i in range(P) for j in range(i + 1)} | {"logdet": logdet, "n": rows["n"]}
                yield pd.DataFrame(out)[_SHAPE]

    return scratch.written(signs.mapInPandas(made, _ESTIMATE), "starts")


def _moments() -> list[Column]:
    """Sums and sums of products of q: whole numbers of 24,000 at most, as logarithms of counts are, so a long holds the sums of 10^10 distinct vectors (beyond, Spark would raise)."""
    return [F.count("*").alias("n"), *(F.sum(q).alias(f"s{i}") for i, q in enumerate(_Q)), *(F.sum(F.col(_Q[i]) * F.col(_Q[j])).alias(f"s{i}_{j}") for i, j in _PAIRS)]


def _concentrated(vectors: DataFrame, now: DataFrame, scratch: Scratch) -> DataFrame:
    """One concentration step: the moments of each group's nearest vectors, by whole classes of distance, made estimates."""
    step = F.floor(16 * F.log2(F.greatest(squared_distance(), F.lit(1e-6)))).cast("int")
    # another key than the join's, so that Spark may split the join where a group is hot
    near = vectors.join(now, "keys").withColumn("step", step).withColumn("group", F.struct("keys", "start"))
    classes = near.groupBy("group", "step").agg(*_moments())
    ordered = W.partitionBy("group").orderBy("step")
    within = F.sum("n").over(ordered) - F.col("n") < SHARE * F.sum("n").over(W.partitionBy("group"))
    inner = classes.withColumn("within", within).where("within").groupBy("group").agg(*(F.sum(c).alias(c) for c in _MOMENTS))
    rows = inner.select("group.keys", "group.start", F.col("n"), *_MOMENTS[1:])
    return scratch.written(rows.mapInPandas(_estimates, _ESTIMATE), "estimates")


def estimates(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """The estimate of every group of ``LEAST`` distinct vectors or more (and of all documents): keys, centre, distance, logdet, n (vectors in its dense part)."""
    each = stats.where(~F.col("base_failed")).select("lang", "source", *_Q).distinct()
    each = each.select(F.explode(_levels(F.col("lang"), F.col("source"))).alias("keys"), *_Q)
    each = scratch.written(each.distinct(), "vectors")
    large = each.groupBy("keys").count().where((F.col("count") >= LEAST) | (F.col("keys.lang") == "*")).select("keys")
    # few files, so that moments are added up within tasks before they move
    vectors = scratch.written(each.join(large, "keys").coalesce(max(1, each.count() // FILE_ROWS)), "vectors")
    scratch.drop(each)
    now = _starts(vectors, scratch)
    for _ in range(STEPS):
        then = _concentrated(vectors, now, scratch)
        both = then.select("keys", "start", F.col("logdet").alias("new")).join(now.select("keys", "start", "logdet"), ["keys", "start"])
        moved = both.where(F.abs(F.col("new") - F.col("logdet")) > 1e-9).limit(1).count()
        scratch.drop(now)
        now = then
        if not moved:
            break
    best = now.groupBy("keys").agg(F.min_by(F.struct(*_SHAPE[2:]), F.struct("logdet", "start")).alias("e")).select("keys", "e.*")
    return scratch.written(best, "best")


def judged(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared) of every document.

    A null text has no words, so it fails; a null language or source is one like others. Documents that fail the plain limits have no part in
    the estimates, and their distance is null. Rows that repeat are judged alike. An empty table gives an empty one. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    stats = scratch.written(statistics(docs), "statistics")
    found = estimates(stats, scratch)
    known = [c for c in stats.columns if not c.startswith("q")]
    # a document's group if it has an estimate, else its language, else all
    own = stats.select("lang", "source").distinct().select("lang", "source", F.posexplode(_levels(F.col("lang"), F.col("source"))).alias("level", "keys"))
    own = own.join(found, "keys").groupBy("lang", "source").agg(F.min_by(F.struct(*_SHAPE[2:-2]), "level").alias("e")).select("lang", "source", "e.*")
    own = scratch.written(own, "groups")
    out = stats.join(own, ["lang", "source"], "left").withColumn("distance", F.when(~F.col("base_failed"), squared_distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_at(1 - tail, P))
    return out.select(*(c for c in known if c not in ("lang", "source")), kept.alias("kept"), "distance")
