"""Toxic passages as maximum-scoring segments of word log-odds.

Every word of the labelled text gets its log-odds of toxic against clean documents, shrunk by how far the labelled
documents bear it out: prior counts for both classes are added to its own. Words differ in kind, so the prior is a
mixture of Dirichlet distributions over the two classes, from clean to toxic ones, whose weights are estimated from all
words' counts. Only labelled text enters, so what a word says does not depend on how much clean text
the corpus holds. A linear-time scan finds all maximal scoring segments of a text; extreme-value statistics of clean
held-out text say how surprising each is for a text of that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import arrow_text

#: The fit sees at most so many labelled rows, those whose id hashes lowest; a fifth of them is held out for calibration.
MAX_LABELLED = 40_000
#: Log-odds around which the prior's Dirichlet distributions lie, how many documents each counts for, and rounds of fitting their weights.
GRID, PRIOR, ROUNDS = np.arange(-4, 8.01, 0.5), 400.0, 200
#: Taken from every word's log-odds, so that a passage must be more toxic than clean by so much a word.
DRIFT = 0.2
#: Clean segments above this quantile of their scores say how fast scores decay; log-odds themselves decay at rate 1.
TAIL = 0.8
#: A document is toxic when a passage as high as its best would turn up in a clean text of its length with at most this probability.
ALPHA = 0.002


@dataclass(frozen=True)
class Model:
    """``hashes`` (sorted) of the scored words, their ``scores``, the score of ``other`` words, which no labelled document holds, and the extreme-value parameters."""

    hashes: np.ndarray
    scores: np.ndarray
    other: float
    decay: float = 1.0
    scale: float = 1.0

    def expected(self, score, length):
        """How many segments of at least ``score`` a clean text of ``length`` words has on average."""
        return self.scale * length * np.exp(-self.decay * score)


def _words(column):
    """For slices of a text column: the first row, the lower-cased bytes, each text's byte bounds, word hashes, the texts' bounds among the words, and word starts."""
    texts = arrow_text.strings(column)
    for lo, hi in arrow_text.slices(texts):
        body, at = arrow_text.raw(pc.utf8_lower(texts[lo:hi]))
        yield (lo, at, *arrow_text.placed_words(body, at, arrow_text.PUNCTUATION))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, end, score)`` of a sequence, in linear time (Ruzzo and Tompa).

    Each has a positive score; they are disjoint, in order, and none can gain by growing or by losing an end.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, nearest entry with a lower total before
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        first, left = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, i + 1, left, total, j))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def passages(hits: np.ndarray, gains: np.ndarray, other: float | np.ndarray) -> list[tuple[int, int, float]]:
    """:func:`segments` of a text whose words at ``hits`` score ``gains`` and all others ``other``, without looking at the others.

    ``other`` may be the scores of all words instead, where those that are no hits must not be above 0.
    """
    if len(hits) == 0:
        return []
    short = np.empty(2 * len(hits) - 1)
    short[::2] = gains
    if np.ndim(other):
        total = np.cumsum(other)
        short[1::2] = total[hits[1:] - 1] - total[hits[:-1]]
    else:
        short[1::2] = other * (np.diff(hits) - 1)
    return [(int(hits[a // 2]), int(hits[(b - 1) // 2]) + 1, s) for a, b, s in segments(short)]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function, for positive numbers, by Stirling's series from 8 on."""
    shift = sum(np.log(x + i) for i in range(8))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Shrunken log-odds of words that so many toxic and clean documents hold, and those of a word that none holds.

    A word with log-odds x is toxic in each document that holds it with odds exp(x) times the average word's. Under each
    Dirichlet prior of the mixture a word's odds are those of its counts and the prior's together; the mixture weighs
    the priors by how well they foretell the counts.
    """
    pairs, which, n = np.unique(np.stack([toxic, clean], axis=1), axis=0, return_inverse=True, return_counts=True)
    t, c = pairs[:, :1], pairs[:, 1:]
    base = np.log(toxic.sum() / clean.sum())
    a = PRIOR / (1 + np.exp(-(base + GRID)))
    b = PRIOR - a
    fit_ = _log_gamma(a + t) + _log_gamma(b + c) - _log_gamma(PRIOR + t + c) - _log_gamma(a) - _log_gamma(b)
    fit_ = np.exp(fit_ - fit_.max(axis=1, keepdims=True))
    weights = np.full(len(GRID), 1 / len(GRID))
    for _ in range(ROUNDS):
        posterior = fit_ * weights
        posterior /= posterior.sum(axis=1, keepdims=True)
        weights = n @ posterior / n.sum()
    posterior = fit_ * weights
    score = (posterior * (np.log((a + t) / (b + c)) - base)).sum(axis=1) / posterior.sum(axis=1)
    return score[which.reshape(-1)], float(weights @ GRID)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", max_labelled=MAX_LABELLED) -> Model | None:
    """Log-odds from a bounded, repeatable sample of labelled documents; None without words in toxic and in clean ones."""
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_labelled).withColumn("held", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0)
    ids = spark.createDataFrame(chosen.collect(), chosen.schema)

    def count(batches):
        """In how many toxic and clean documents each word occurs."""
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, hashes, bounds, _ in _words(batch.column(0)):
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                order = np.lexsort((doc, hashes))
                h, d = hashes[order], doc[order]
                once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
                h, toxic = h[once], y[first + d[once]] == 1
                at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
                n, of = np.diff(np.append(at, len(h))), np.add.reduceat(toxic.astype(np.int64), at) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(of), pa.array(n - of)], names=["h", "toxic", "clean"])

    seen = text.join(F.broadcast(ids.where("NOT held").select("id", "y")), "id").select("text", "y")
    counted = arrow_text.mapped(seen, count, "h bigint, toxic bigint, clean bigint").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    vocabulary = counted.column("h").to_numpy().view(np.uint64)
    order = vocabulary.argsort()
    vocabulary, toxic, clean = vocabulary[order], counted.column("toxic").to_numpy()[order].astype(float), counted.column("clean").to_numpy()[order].astype(float)
    if not toxic.sum() or not clean.sum():
        return None
    scores, other = log_odds(toxic, clean)
    # Clean text must lose by the word, or segments would grow with the text.
    drift = DRIFT + max(0.0, other, float(clean @ scores / clean.sum()))
    model = Model(vocabulary, scores - drift, other - drift)
    held = text.join(F.broadcast(ids.where("y = 0 AND held").select("id")), "id")
    found = _scan(held.select(F.col("id"), "text"), spark.sparkContext.broadcast(model), None).select(F.explode("passages.score").alias("score")).toArrow().column("score").to_numpy()
    length = _lengths(held)
    # Peaks over a floor: the clean segments' excess gives the rate of decay, which words that are toxic by chance make
    # slower than the theory's, and their number the scale. The theory's own rate counts as one more observation.
    floor = float(np.quantile(found, TAIL)) if len(found) else 0.0
    excess = np.sort(found[found >= floor] - floor)
    decay = min(model.decay, (len(excess) + 1) / (float(excess.sum()) + 1 / model.decay))
    return Model(model.hashes, model.scores, model.other, decay, (len(excess) + 1) / max(1, length) * float(np.exp(decay * floor)))


def _lengths(held: DataFrame) -> int:
    def run(batches):
        n = 0
        for batch in batches:
            n += sum(len(hashes) for _, _, hashes, _, _ in _words(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return arrow_text.mapped(held.select("text"), run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _scan(texts: DataFrame, shared, alpha: float | None) -> DataFrame:
    """``id, score, words, p_value, passages`` of the texts ``(id, text)`` that have a scoring segment, or one significant at ``alpha``; without ``alpha`` passages are all segments, without their text."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            ids, texts_ = batch.column(0), arrow_text.strings(batch.column(1))
            rows: list[tuple] = []
            for first, at, hashes, bounds, starts in _words(batch.column(1)):
                where = np.searchsorted(m.hashes, hashes)
                where[where == len(m.hashes)] = 0
                gain = np.where(m.hashes[where] == hashes, m.scores[where], m.other)
                hits = np.flatnonzero(gain > 0)
                spans = np.searchsorted(hits, bounds)
                for doc in np.flatnonzero(np.diff(spans)):
                    mine = hits[spans[doc] : spans[doc + 1]]
                    n = int(bounds[doc + 1] - bounds[doc])
                    found = passages(mine - bounds[doc], gain[mine], gain[bounds[doc] : bounds[doc + 1]])
                    best = max(s for _, _, s in found)
                    p = float(-np.expm1(-m.expected(best, n)))
                    if alpha is not None and p > alpha:
                        continue
                    shown = []
                    if alpha is None:
                        shown = [{"score": s, "text": None} for _, _, s in found]
                    else:
                        lowered = None
                        for a, b, s in found:
                            if -np.expm1(-m.expected(s, n)) <= alpha:
                                lowered = pc.utf8_lower(texts_[first + int(doc)]).as_py().encode() if lowered is None else lowered
                                i, j = starts[bounds[doc] + a], starts[bounds[doc] + b] if bounds[doc] + b < bounds[doc + 1] else at[doc + 1]
                                shown.append({"score": s, "text": lowered[i - at[doc] : j - at[doc]].decode().rstrip()})
                    rows.append((first + int(doc), best, n, p, shown))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.list_(pa.struct([("score", pa.float64()), ("text", pa.string())]))),
                ],
                names=["id", "score", "words", "p_value", "passages"],
            )

    return arrow_text.mapped(texts, run, f"id {kind}, score double, words bigint, p_value double, passages array<struct<score: double, text: string>>")


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", alpha=ALPHA, max_labelled=MAX_LABELLED) -> DataFrame:
    """The toxic documents: ``id_col``, ``p_value``, the best segment's ``score``, and every significant passage with its score, in text order and lower case.

    ``labels`` holds ``id_col`` and ``label_col`` (1 toxic, 0 not) for any part of the documents; a document with both
    labels is toxic. Null, empty and wordless texts are not toxic. A row with a null id is judged like any other.
    Repeated rows are judged and returned each. Without toxic or without clean labels nothing is toxic. A very long
    text is scanned whole, as one task's work; its length counts against its passages. Words are runs of letters, digits
    and apostrophes and of all that is not ASCII, so a text in a script without blanks is matched by its longer runs
    only. Passages of equal score are all returned. Other columns are not read. An empty table gives an empty one.
    """
    model = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    if model is None:
        texts, model = texts.where("false"), Model(np.zeros(1, np.uint64), np.zeros(1), -1.0)
    found = _scan(texts, docs.sparkSession.sparkContext.broadcast(model), alpha)
    return found.select(F.col("id").alias(id_col), "p_value", "score", "passages")
