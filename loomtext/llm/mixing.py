"""Mixing sources to target weights when a document belongs to several domains in part.

A classifier fitted to a labelled table gives every document a posterior over domains. Nonnegative rates, one for each
document, then bring the expected domain totals (sum of rate * tokens * posterior) to the targets by least squares:
accelerated projected gradient from rates of 1, a step being one pass over a stored table of the documents' posteriors
and rates. Residuals are weighed by the inverse of the posteriors' second moments, in which the problem is well
conditioned however rare a domain is.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import arrow_text
from loomtext.llm.storage import discard, fresh, written

#: The classifier sees at most so many labelled rows, those whose id hashes lowest: half of them for its weights, half for its calibration.
MAX_LABELLED = 6_000
#: Text features are trigrams of bytes, hashed to so many bits.
FEATURE_BITS = 15
#: Steps stop when no domain's total misses its target by more than ``TOLERANCE``, or when they no longer help.
MAX_STEPS, TOLERANCE, PATIENCE = 200, 1e-4, 30
#: Rates are stored after so many steps; between, each pass takes the steps since then again.
STORE_EVERY = 12


def trigrams(column):
    """For slices of a text column: the first row, hashed trigrams (of the lower-cased text and a blank), their bounds, and the texts' numbers of words."""
    texts = arrow_text.strings(column)
    for lo, hi in arrow_text.slices(texts):
        body, at = arrow_text.raw(pc.utf8_lower(texts[lo:hi]))
        wide = np.concatenate([body, np.full(2, 32, np.uint8)]).astype(np.uint32)
        code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        space = arrow_text._SPACE[body]
        first = ~space
        first[1:] &= space[:-1]
        edges = at[:-1][at[:-1] < len(body)]
        first[edges] = ~space[edges]
        words = np.diff(np.append(0, first.cumsum())[at])
        # Past a text's end come blanks, and not its neighbour: a text's trigrams are those that it has alone.
        ends = at[1:]
        code[ends[np.diff(at) > 0] - 1] = (code[ends[np.diff(at) > 0] - 1] & np.uint32(0xFF0000)) | np.uint32(0x2020)
        two = ends[np.diff(at) > 1] - 2
        code[two] = (code[two] & np.uint32(0xFFFF00)) | np.uint32(0x20)
        yield lo, (code * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS), at, words


@dataclass
class Classifier:
    """``weights`` (domain, feature) are log-probabilities; ``slope`` and ``bias`` turn a text's mean of them into log-posteriors."""

    weights: np.ndarray
    slope: np.ndarray
    bias: np.ndarray

    def means(self, codes, at):
        n = np.diff(at)
        out = np.zeros((len(n), len(self.weights)))
        some = np.flatnonzero(n)
        if len(some):
            for k in range(out.shape[1]):  # a domain at a time: its weights stay in cache, and no row of all is made for each byte
                out[some, k] = np.add.reduceat(self.weights[k][codes], at[:-1][some], dtype=np.float64) / n[some]
        return out - out.mean(axis=1, keepdims=True)

    def posteriors(self, means):
        score = means @ self.slope + self.bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def calibrate(means: np.ndarray, y: np.ndarray, k: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on standardised means, lightly penalised, by gradient descent."""
    scale = max(1e-9, means.std())
    x = means / scale
    hot = np.eye(k)[y]
    slope, bias = np.zeros((k, k)), np.zeros(k)
    rate = 4.0 / max(1.0, float((x**2).sum(axis=1).mean()) + 1)
    for _ in range(steps):
        s = x @ slope + bias
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope += rate * (x.T @ (hot - p) / len(x) - 1e-4 * slope)
        bias += rate * (hot - p).mean(axis=0)
    return slope / scale, bias


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, max_labelled: int = MAX_LABELLED) -> Classifier | None:
    """None when fewer than two of the domains have labelled documents."""
    spark, k = docs.sparkSession, len(domains)
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain").cast("string")) - 1
    chosen = labelled.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), number.cast("int").alias("y")).where("y >= 0").groupBy("id").agg(F.min("y").alias("y"))
    rows = chosen.orderBy(F.xxhash64("id"), "id").limit(max_labelled).withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")).collect()
    if len({r.y for r in rows}) < 2:
        return None
    sample = spark.createDataFrame(rows, "id {}, y int, half int".format(docs.schema[id_col].dataType.simpleString()))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "id")

    def count(batches):
        sums = np.zeros((k, 1 << FEATURE_BITS), np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for first, codes, at, _ in trigrams(batch.column(0)):
                feature = codes + (np.repeat(y[first : first + len(at) - 1], np.diff(at)).astype(np.int64) << FEATURE_BITS)
                sums += np.bincount(feature, minlength=sums.size).reshape(sums.shape)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at])], names=["f", "n"])

    sums = np.zeros(k << FEATURE_BITS)
    for f, n in arrow_text.mapped(text.where("half = 0").select("text", "y"), count, "f bigint, n bigint").groupBy("f").agg(F.sum("n")).collect():
        sums[f] = n
    sums = sums.reshape(k, -1)
    weights = np.log((sums + 0.5) / (sums.sum(axis=1, keepdims=True) + 0.5 * sums.shape[1])).astype(np.float32)
    model = spark.sparkContext.broadcast(Classifier(weights, np.eye(k), np.zeros(k)))

    def means(batches):
        for batch in batches:
            for first, codes, at, _ in trigrams(batch.column(0)):
                m = model.value.means(codes, at)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(m)), pa.array(list(m), pa.list_(pa.float64()))], names=["y", "m"])

    held = arrow_text.mapped(text.where("half = 1").select("text", "y"), means, "y int, m array<double>").collect()
    if not held:
        return None
    held.sort(key=lambda r: (r.y, r.m))
    slope, bias = calibrate(np.array([r.m for r in held]), np.array([r.y for r in held]), k)
    # A domain without labelled documents has no posterior.
    bias[sums.sum(axis=1) == 0] = -1e9
    return Classifier(model.value.weights, slope, bias)


@dataclass
class Steps:
    """The steps that every document's rate takes, whatever its posterior ``p``: to ``max(0, ahead - p @ slope)``, and ``momentum`` of the way beyond."""

    taken: list[tuple[np.ndarray, float]]
    totals: np.ndarray | None = None

    def replay(self, p: np.ndarray, rate=None, ahead=None) -> tuple[np.ndarray, np.ndarray]:
        """The rates after all steps, and the point from which the next one would be taken."""
        rate = np.ones(len(p)) if rate is None else rate
        ahead = rate if ahead is None else ahead
        for slope, momentum in self.taken:
            new = np.maximum(0.0, ahead - p @ slope)
            rate, ahead = new, new + momentum * (new - rate)
        return rate, ahead


def _matrix(column, k: int) -> np.ndarray:
    """An Arrow column of lists of ``k`` numbers as an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def solve(parts: DataFrame, weights: np.ndarray, total: float, store_every: int = STORE_EVERY) -> Steps:
    """The steps for the documents ``(p array<double>, n bigint)``: posteriors and tokens.

    Least are ``(totals - weights) @ C @ (totals - weights)`` over rates of at least 0, with C the inverse of
    ``sum(n * p * p.T) / total``. In that measure no step of length 1 overshoots, and where many rates are 0 longer ones
    do not.
    """
    k = len(weights)
    schema = "p array<double>, n bigint, rate double, ahead double"

    def moments(batches):
        s = np.zeros(k * k)
        for batch in batches:
            p, n = _matrix(batch.column(0), k), batch.column(1).to_numpy() / total
            s += (p.T @ (p * n[:, None])).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(s.reshape(1, -1).tolist(), pa.list_(pa.float64()))], names=["s"])

    def summed(df):
        return np.sum([r.s for r in df.collect()], axis=0)

    metric = np.linalg.pinv(summed(arrow_text.mapped(parts.select("p", "n"), moments, "s array<double>")).reshape(k, k), rcond=1e-12, hermitian=True)
    state = parts.select("p", "n", F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    kept, since = Steps([]), Steps([])
    root = np.linalg.cholesky(metric + 1e-12 * np.trace(metric) * np.eye(k))
    t, best, stale, longest = 1.0, np.inf, 0, 1.0
    for nth in range(MAX_STEPS + 1):

        def totals(batches, now=Steps(list(since.taken))):
            s = np.zeros(2 * k + k * k)
            for batch in batches:
                p, n = _matrix(batch.column(0), k), batch.column(1).to_numpy() / total
                rate, ahead = now.replay(p, batch.column(2).to_numpy(), batch.column(3).to_numpy())
                s += np.concatenate([(n * rate) @ p, (n * ahead) @ p, (p.T @ (p * (n * (ahead > 0))[:, None])).reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(s.reshape(1, -1).tolist(), pa.list_(pa.float64()))], names=["s"])

        s = summed(arrow_text.mapped(state, totals, "s array<double>"))
        kept.totals = s[:k]
        miss = kept.totals - weights
        value = float(miss @ metric @ miss)
        # A domain of which there is nothing is out of reach.
        if np.abs(miss[kept.totals > 0]).max(initial=0.0) <= TOLERANCE / 2 or nth == MAX_STEPS:
            break
        if value > best * (1 - 1e-6):
            stale += 1
            if stale > PATIENCE:
                break
        else:
            stale = 0
        if value > best:
            t, longest = 1.0, max(1.0, longest / 4)  # what was gained by going beyond is lost again: start anew from here
        best = min(best, value)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        curved = np.linalg.eigvalsh(root.T @ s[2 * k :].reshape(k, k) @ root)[-1]
        length, longest = min(longest, max(1.0, 1 / max(curved, 1e-9))), 2 * longest
        step = (length * (metric @ (s[k : 2 * k] - weights)), (t - 1) / after)
        t = after
        kept.taken.append(step)
        since.taken.append(step)
        if len(since.taken) == store_every:

            def move(batches, now=Steps(list(since.taken))):
                for batch in batches:
                    rate, ahead = now.replay(_matrix(batch.column(0), k), batch.column(2).to_numpy(), batch.column(3).to_numpy())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rate), pa.array(ahead)], names=["p", "n", "rate", "ahead"])

            old, state = state, written(arrow_text.mapped(state, move, schema), "rates")
            discard(old)
            since = Steps([])
    discard(state)
    if np.abs(miss).max() > TOLERANCE:
        warnings.warn(f"mixing: targets {weights.round(5).tolist()} are not met, but {kept.totals.round(5).tolist()}", stacklevel=2)
    return kept


def rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col="doc_id", text_col="text", tokens: float | None = None, max_labelled=MAX_LABELLED, rate_col="rate", columns: list[str] | None = None) -> DataFrame:
    """``docs`` and ``rate_col``: how often each document should be seen for the domains' shares to meet ``targets``.

    ``labelled`` holds ``id_col`` and ``domain`` for any part of the documents; of several domains of one document the
    first in ``targets`` counts, and other domains are ignored. ``targets`` are weights (they are scaled to sum to 1)
    of the ``tokens`` wanted, by default as many as there are; a token is a white-space separated word. A domain
    without labelled documents has posterior 0. Targets that no rates can meet are met as nearly as can be, with a
    warning. With fewer than two labelled domains, and for a null, empty or blank text, the rate is 1. Null ids and
    repeated rows are rated like any others; texts of one posterior have one rate. A very long text is read whole, as
    one task's work. All columns are kept, or those in ``columns``; one named like ``rate_col`` is replaced. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop(rate_col)
    domains = list(targets)
    k = len(domains)
    names = [c for c in docs.columns if columns is None or c in columns]
    model = fit_classifier(docs, labelled, domains, id_col, text_col, max_labelled)
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in names], F.lit(1.0).alias(rate_col))
    shared = spark.sparkContext.broadcast(model)
    text_, p_, n_ = fresh(docs.columns, "text", "posterior", "words")
    asked = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(text_))
    schema = T.StructType([*asked.schema.fields[:-1], T.StructField(p_, T.ArrayType(T.DoubleType())), T.StructField(n_, T.LongType())])

    def judged(batches):
        for batch in batches:
            for first, codes, at, words in trigrams(batch.column(len(names))):
                p = shared.value.posteriors(shared.value.means(codes, at))
                p = pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), k).cast(pa.list_(pa.float64()))
                rows = batch.slice(first, len(p)).drop_columns([text_])
                yield pa.RecordBatch.from_arrays([*rows.columns, p, pa.array(words)], names=[*rows.schema.names, p_, n_])

    # Texts are scored once: the solver reads the posteriors of this table, and what is returned all of it.
    posteriors = written(arrow_text.mapped(asked, judged, schema), "posteriors")
    parts = posteriors.select(F.col(p_).alias("p"), F.col(n_).alias("n")).where("n > 0")
    total = parts.agg(F.sum("n")).first()[0] or 0
    wanted = np.array([targets[d] for d in domains], float)
    steps = solve(parts, wanted / wanted.sum() * ((tokens or total) / total), float(total)) if total else Steps([])
    out = T.StructType([*asked.schema.fields[:-1], T.StructField(rate_col, T.DoubleType())])

    def rate(batches):
        for batch in batches:
            rates = np.where(batch.column(n_).to_numpy() > 0, steps.replay(_matrix(batch.column(p_), k))[0], 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rates)], names=[*batch.schema.names[:-2], rate_col])

    return arrow_text.mapped(posteriors, rate, out)


def copies(rate, id_, seed: int = 0):
    """How often a document is taken: its rate, rounded up or down at random with that mean; the same for the same ``id_`` (a column, or several) and seed."""
    unit = F.pmod(F.xxhash64(*(id_ if isinstance(id_, (list, tuple)) else [id_]), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col="doc_id", text_col="text", seed: int = 0, **how) -> DataFrame:
    """``docs``, each row as often as its rate says (:func:`rated`, :func:`copies`), with its columns as they were."""
    (rate_,) = fresh(docs.columns, "rate")
    taken = rated(docs, labelled, targets, id_col, text_col, rate_col=rate_, **how)
    # The text decides too, for rows without an id not to share one draw.
    times = copies(F.col(rate_), [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")], seed)
    (each_,) = fresh(taken.columns, "each")
    return taken.where(times > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(True), times)).alias(each_)).drop(each_)
