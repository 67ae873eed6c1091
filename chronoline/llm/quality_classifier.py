"""Operator 5: positive-unlabelled quality classifier.

A logistic score over ratios of the whole text minimises the non-negative unbiased
risk  ``pi * P[l(+)] + max(0, U[l(-)] - pi * P[l(-)])``: P averages over trusted
positives (label 1 of the learning folds), U over the text of every document, and
``pi`` is the class prior. It is estimated from P and U alone (``estimate_prior``): U holds P with weight pi, so for no
region does pi exceed the ratio of U's share to P's; the least ratio over the upper tails of a linear score that
separates P from U, each share moved by one standard error, is taken. With the logistic
loss the unbiased risk is convex; damped Newton steps reduce it, and a step that takes the
negative part under zero is corrected by climbing that part's own gradient. Each step is one pass over the feature table
(a few dozen bytes a document); only sums of fixed size reach the driver. Labels 0 are never read.

Labels come only from documents with crc32(doc_id as text) mod 5 other than 0.
Labels, language, source and id are never inputs of a score.

Defined cases: null and empty texts have all-zero ratios and get the score of
that point; several labels of one document count as 1 if any is 1; null labels are
left out; a null id has no label and counts as held out; repeated rows are scored
one by one; without any label 1 to learn from every score is 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import checkpoint

FOLDS = 5
THRESHOLD = 0.3
#: Ridges to choose from, by the learning folds alone; what is fitted for the choice is a sample of at most RIDGE_ROWS of their rows, by hash, spread over RIDGE_PARTS parts.
RIDGES = (1e-4, 3e-4, 1e-3, 3e-3, 1e-2)
RIDGE_ROWS = 8192
RIDGE_PARTS = 4
MAX_STEPS = 25
TOLERANCE = 1e-5
PRIOR_BINS = 512
PRIOR_LIMITS = (0.05, 0.95)
#: Tails with a smaller share of P say too little about the prior.
LEAST_TAIL = 0.1

FEATURES = (
    "bias", "symbols", "pipes", "shouts", "upper", "digits", "ends", "commas", "short_words", "word_chars",
    "distinct_words", "adjacent_repeats", "repeated_lines", "non_ascii",
)


def features(text: str | None) -> list[float]:
    """Ratios of the whole text, each squeezed by log1p so that small shares of junk still count."""
    data = (text or "").encode()
    if not data:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = max(1, int(hist[33:].sum()))
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    of = lambda marks: int(hist[list(marks)].sum()) / n
    ratios = (
        of(b"#*$%&<>"), of(b"|"), of(b"!"), upper / max(1, upper + lower), int(hist[48:58].sum()) / chars, of(b".?"), of(b","),
        sum(map((4).__gt__, map(len, words))) / n, chars / n / 10, min(1.0, len(set(words)) / n ** 0.9), sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), int(hist[128:].sum()) / chars,
    )
    return [1.0, *np.log1p(20.0 * np.array(ratios)).tolist()]


def fold_is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def feature_table(docs: DataFrame) -> DataFrame:
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return source.mapInArrow(run, f"doc_id {kind}, x array<double>")


def training_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, x, held_out and y: the label where it may be learnt from, else null."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    table = feature_table(docs).join(known, "doc_id", "left").withColumn("held_out", fold_is_held_out(F.col("doc_id")))
    return checkpoint(table.select("doc_id", "x", "held_out", F.when(~F.col("held_out"), F.col("y")).alias("y")))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -40, 40)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


@dataclass(frozen=True)
class Sums:
    """Over one pass, at some weights: U gradient and Hessian, P gradient of l(-), and sums of U[l(-)], P[l(+)] and P[l(-)]."""

    gradient: np.ndarray
    hessian: np.ndarray
    positive_gradient: np.ndarray
    u_neg: float
    p_pos: float
    p_neg: float


def part_sums(x: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """All sums of one batch as one vector."""
    z = x @ weights
    s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    losses = [np.logaddexp(0, z).sum(), np.logaddexp(0, -z[positive]).sum(), np.logaddexp(0, z[positive]).sum()]
    return np.concatenate([s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel(), s[positive] @ x[positive], losses])


def _total(table: DataFrame, size: int, part) -> np.ndarray:
    """Sum over all rows of part(x, positive), a vector of so many values: as many rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += part(_matrix(batch.column(0)), np.asarray(batch.column(1).fill_null(0)) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["k", "v"])

    total = np.zeros(size)
    for row in table.select("x", "y").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        total[row["k"]] = row["v"]
    return total


def _sums(table: DataFrame, weights: np.ndarray) -> Sums:
    d = len(weights)
    t = _total(table, 2 * d + d * d + 3, lambda x, positive: part_sums(x, positive, weights))
    return Sums(t[:d], t[d : d + d * d].reshape(d, d), t[d + d * d : 2 * d + d * d], *t[-3:].tolist())


def tail_bound(u: np.ndarray, p: np.ndarray) -> float:
    """Least ratio of U's share to P's over the upper tails of two histograms, each moved by one standard error."""
    tail_u, tail_p = (np.cumsum(h[::-1]) / max(1.0, h.sum()) for h in (u, p))
    error = lambda share, n: np.sqrt(share * (1 - share) / max(1.0, n))
    ratio = (tail_u + error(tail_u, u.sum())) / np.maximum(tail_p - error(tail_p, p.sum()), 1e-12)
    return float(np.clip(ratio[tail_p >= LEAST_TAIL].min(initial=1.0), *PRIOR_LIMITS))


def estimate_prior(table: DataFrame, mean_p: np.ndarray, n: int) -> float:
    """Class prior of U, from P and U alone: the tail bound along the direction that separates their means best."""
    at_zero = _sums(table, np.zeros(len(mean_p)))  # there the gradient is half the sum, the Hessian a quarter of the second moments
    mean_u = 2 * at_zero.gradient / n
    spread = 4 * at_zero.hessian / n - np.outer(mean_u, mean_u) + 1e-4 * np.eye(len(mean_u))
    direction = np.linalg.solve(spread, mean_p - mean_u)
    middle, width = float(mean_u @ direction), max(1e-9, float(np.sqrt(direction @ spread @ direction)))

    def histograms(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = np.clip((x @ direction - middle) / width, -7.99, 7.99)
        bins = ((z + 8) * (PRIOR_BINS / 16)).astype(np.int64)
        return np.concatenate([np.bincount(bins, minlength=PRIOR_BINS), np.bincount(bins[positive], minlength=PRIOR_BINS)])

    both = _total(table, 2 * PRIOR_BINS, histograms)
    return tail_bound(both[:PRIOR_BINS], both[PRIOR_BINS:])


def minimise(sums: Callable[[np.ndarray], Sums], n_u: int, n_p: int, mean_p: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """Weights of least non-negative PU risk plus ridge, by damped Newton steps and corrections; sums gives the totals at some weights."""
    d = len(mean_p)
    ridges = np.full(d, ridge)
    ridges[0] = ridge / 10

    def state(w: np.ndarray) -> tuple:
        """Risk, its negative part, and what the next step and a correction need."""
        t = sums(w)
        negative = t.u_neg / n_u - prior * t.p_neg / n_p
        risk = prior * t.p_pos / n_p + max(0.0, negative) + 0.5 * float(ridges @ (w * w))
        climb = t.gradient / n_u - prior * t.positive_gradient / n_p
        return risk, negative, climb, t.gradient / n_u - prior * mean_p + ridges * w, t.hessian / n_u + np.diag(ridges)

    w, damp = np.zeros(d), 1.0
    w[0] = np.log(prior / (1 - prior))
    now = state(w)
    for _ in range(MAX_STEPS):
        tried = w - damp * np.linalg.solve(now[4], now[3])
        new = state(tried)
        if new[1] < 0:  # the correction: back to where the negative part is zero, along its own gradient
            tried = tried - 1.01 * new[1] * new[2] / max(1e-12, float(new[2] @ new[2]))
            new = state(tried)
        if new[1] < 0 or new[0] > now[0] + 1e-12:
            damp /= 4
            if damp < 1e-3:
                break
            continue
        gain, w, now = now[0] - new[0], tried, new
        damp = min(1.0, damp * 2)
        if gain < TOLERANCE:
            break
    return w


def array_sums(x: np.ndarray, positive: np.ndarray) -> Callable[[np.ndarray], Sums]:
    def sums(w: np.ndarray) -> Sums:
        d, t = len(w), part_sums(x, positive, w)
        return Sums(t[:d], t[d : d + d * d].reshape(d, d), t[d + d * d : 2 * d + d * d], *t[-3:].tolist())

    return sums


def choose_ridge(x: np.ndarray, positive: np.ndarray, part: np.ndarray, prior: float) -> float:
    """The ridge whose fits on all parts but one have the least mean risk on that one; the larger on ties, the largest where a part has no positives to learn from or to judge by."""
    told = [k for k in np.unique(part) if positive[part == k].any() and positive[part != k].any()]
    if not told:
        return max(RIDGES)

    def risk(ridge: float) -> float:
        total = 0.0
        for k in told:
            own, rest = part == k, part != k
            w = minimise(array_sums(x[rest], positive[rest]), int(rest.sum()), int(positive[rest].sum()), x[rest][positive[rest]].mean(axis=0), prior, ridge)
            t = array_sums(x[own], positive[own])(w)
            n_p = positive[own].sum()
            total += prior * t.p_pos / n_p + max(0.0, t.u_neg / own.sum() - prior * t.p_neg / n_p)
        return total

    return min(RIDGES, key=lambda ridge: (round(risk(ridge), 9), -ridge))


def fit(table: DataFrame) -> Model:
    """Non-negative PU risk over training_table rows."""
    d = len(FEATURES)
    counts = table.agg(
        F.count("*").alias("u"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"),
        *[F.avg(F.when(F.col("y") == 1, F.get("x", F.lit(i)))).alias(f"m{i}") for i in range(d)],
    ).first()
    if not counts["p"]:
        return Model((0.0,) * d, 0.5)
    n_u, n_p = counts["u"], counts["p"]
    mean_p = np.array([counts[f"m{i}"] for i in range(d)])
    prior = estimate_prior(table, mean_p, n_u)
    order = F.xxhash64("doc_id", "x")
    learning = table.where("not held_out").select("x", F.coalesce(F.col("y") == 1, F.lit(False)).alias("positive"), F.pmod(order, F.lit(RIDGE_PARTS)).alias("part"), order.alias("o"))
    rows = learning.orderBy("o", "positive").limit(RIDGE_ROWS).drop("o").toArrow()
    sample = _matrix(rows.column("x").combine_chunks()), np.asarray(rows.column("positive").combine_chunks()).astype(bool), np.asarray(rows.column("part"))
    ridge = choose_ridge(*sample, prior) if len(rows) else max(RIDGES)
    return Model(tuple(minimise(lambda w: _sums(table, w), n_u, n_p, mean_p, prior, ridge).tolist()), prior)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    table = training_table(docs, labels)
    model = fit(table)
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(2))) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return table.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with all their columns; texts are scored in place and never shuffle."""
    model = fit(training_table(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(len(batch), len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
