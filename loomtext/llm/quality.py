"""A quality classifier that is a sparse ensemble of rules, compiled to Spark column expressions.

Shallow boosted trees are fitted to text statistics of labelled documents; each path from a root is a conjunction of
comparisons. A lasso-penalised logistic fit picks few of these rules and weighs them. What is applied to the corpus is
a sum of ``when`` expressions over statistics that Spark computes itself; no Python runs there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.storage import fresh

#: The fit sees at most so many labelled rows, those whose id hashes lowest.
MAX_LABELLED = 12_000
#: Share of the good documents among the labelled ones that are held out (a fifth) that the cut-off must keep.
KEEP_GOOD = 0.998
TREES, DEPTH, SHRINK, CUTS = 40, 3, 0.3, 24
PENALTY, STEPS = 2e-3, 300


def statistics(text: Column) -> dict[str, Column]:
    """Named numbers that describe a whole text; a null text counts as an empty one, whose statistics are all defined."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    some = F.greatest(chars, F.lit(1))
    words = F.split(F.trim(text), r"\s+")
    lines = F.split(text, "\n")
    n_words, n_lines = F.size(words), F.size(lines)

    def share(pattern):
        return (chars - F.length(F.regexp_replace(text, pattern, ""))) / some

    return {
        "chars": F.log1p(chars.cast("double")),
        "word_length": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "word_variety": F.size(F.array_distinct(words)) / F.sqrt(n_words.cast("double")),
        # Words that the next one repeats. Without a loop over groups, which would take stack by the word.
        "repeats": share(r"(?<!\S)(\S+)\s(?=\1(?!\S))"),
        "upper": share(r"\p{Lu}+"),
        "digits": share(r"\p{N}+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+"),
        "exclaims": share("[!?]+"),
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_length": F.log1p(chars / n_lines),
    }


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (statistic, above?, bound) must hold; ``weight`` is then added to the score."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, bound in self.tests:
            out &= (x[:, j] > bound) == above
        return out

    def column(self, values: list[Column]) -> Column:
        said = [values[j] > F.lit(bound) if above else values[j] <= F.lit(bound) for j, above, bound in self.tests]
        cond = said[0]
        for more in said[1:]:
            cond = cond & more
        return F.when(cond, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    intercept: float
    cut: float

    def score(self, values: list[Column]) -> Column:
        """The log-odds that the document is good."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + rule.column(values)
        return total

    def score_array(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for rule in self.rules:
            out += rule.weight * rule.holds(x)
        return out


def _tree(x, cuts, grad, hess, rows, depth, tests, found):
    """Grows one regression tree on the loss's gradients; returns its prediction for all rows of ``x`` and notes its paths."""
    value = grad[rows].sum() / (hess[rows].sum() + 1.0)
    out = np.zeros(len(x))
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        g, h = grad[rows], hess[rows]
        base = g.sum() ** 2 / (h.sum() + 1)
        for j, bounds in enumerate(cuts):
            if len(bounds) == 0:
                continue
            at = np.searchsorted(bounds, x[rows, j], side="left")
            gs, hs, ns = (np.bincount(at, w, len(bounds) + 1).cumsum()[:-1] for w in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
            gain[(ns < 5) | (len(rows) - ns < 5)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, float(bounds[k])))
    if best[1] is None:
        out[rows] = value
        return out
    j, bound = best[1]
    above = x[rows, j] > bound
    for side, part in ((True, rows[above]), (False, rows[~above])):
        path = (*tests, (j, side, bound))
        found.append(Rule(path))
        out += _tree(x, cuts, grad, hess, part, depth - 1, path, found)
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, trees=TREES, depth=DEPTH) -> list[Rule]:
    """The paths of boosted trees, of which each set of rows is described once."""
    cuts = []
    for j in range(x.shape[1]):
        cuts.append(np.unique(np.quantile(x[:, j], np.linspace(0.005, 0.995, CUTS * 4))) if len(x) else np.zeros(0))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    score, found = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        score += SHRINK * _tree(x, cuts, weight * (y - p), weight * p * (1 - p), np.arange(len(x)), depth, (), found)
    seen, out = set(), []
    for rule in found:
        key = np.packbits(rule.holds(x)).tobytes()
        if key not in seen:
            seen.add(key)
            out.append(rule)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty=PENALTY, steps=STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the classes weigh equally and the intercept isn't penalised."""
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    a = np.hstack([r, np.ones((len(r), 1))])
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (weight * (a @ v))
        v /= np.linalg.norm(v)
    step = 4 / max(1e-9, v @ (a.T @ (weight * (a @ v)))) / 1.05
    b = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ z)))
        new = z + step * (a.T @ (weight * (y - p)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * penalty)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, b, t = new + (t - 1) / t_new * (new - b), new, t_new
    return b[:-1], float(b[-1])


def fit_arrays(x: np.ndarray, y: np.ndarray, keep_good: float = KEEP_GOOD, held: np.ndarray | None = None) -> Model:
    """Rules and weights of the rows that are not ``held`` out; the cut-off is the lowest that keeps ``keep_good`` of the good ones held out.

    With one class only, or no rows, the model keeps everything but blank texts.
    """
    held = np.zeros(len(y), bool) if held is None else held
    x_held, y_held, x, y = x[held], y[held], x[~held], y[~held]
    if len(y) == 0 or y.min() == y.max():
        return Model((), 0.0, 0.0)
    rules = extract_rules(x, y)
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))
    weights, intercept = lasso_logistic(r, y)
    kept = tuple(Rule(rule.tests, float(w)) for rule, w in zip(rules, weights, strict=True) if abs(w) > 1e-9)
    model = Model(kept, intercept, 0.0)
    good = np.sort(model.score_array(x_held)[y_held == 1] if (y_held == 1).any() else model.score_array(x)[y == 1])
    lowest = good[int(np.floor((1 - keep_good) * len(good)))]
    return Model(kept, intercept, float(min(0.0, lowest) - 1e-9))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", max_labelled=MAX_LABELLED, keep_good=KEEP_GOOD) -> Model:
    """Fitted to a bounded, repeatable sample of the labelled documents; null labels, ids and texts take no part."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    stats = statistics(F.col("t"))
    held = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0
    rows = text.join(F.broadcast(chosen), "id").select("id", "y", held.cast("double"), *[c.cast("double").alias(f"s{i}") for i, c in enumerate(stats.values())]).collect()
    data = np.array(sorted(tuple(r) for r in rows), dtype=float).reshape(len(rows), len(stats) + 3)
    return fit_arrays(data[:, 3:], data[:, 1], keep_good, data[:, 2] == 1)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` and the log-odds of being good; null for a null or blank text. A column of that name is replaced."""
    docs = docs.drop(score_col)
    names = fresh(docs.columns, *[f"s{i}" for i in range(len(statistics(F.lit(""))))])
    stats = [c.cast("double").alias(n) for n, c in zip(names, statistics(F.col(f"`{text_col}`")).values(), strict=True)]
    wide = docs.select("*", *stats)
    # The rules name each statistic many times. A generated row keeps the optimizer from writing the statistics out in each.
    inner = fresh(wide.columns, *[f"v{i}" for i in range(len(names))])
    rows = wide.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(*[F.col(n).alias(m) for n, m in zip(names, inner, strict=True)]))))
    score = F.when(F.coalesce(F.trim(F.col(f"`{text_col}`")), F.lit("")).rlike(r"\S"), model.score([F.col(m) for m in inner]))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], score.alias(score_col))


def good_documents(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", max_labelled=MAX_LABELLED, keep_good=KEEP_GOOD, score_col="quality_score") -> DataFrame:
    """The documents that the classifier keeps, with their score.

    ``labels`` holds ``id_col`` and ``label_col`` (1 good, 0 not); it may label any part of the documents, and a
    document twice: with both labels it counts for both. Equal scores fare alike. A very long text is measured whole, as
    one row's work. A null or blank text is rejected. A null id is no obstacle. Repeated rows are judged alike. With no
    labels, or of one class only, all but blank texts stay. Every other column is kept; one named like ``score_col`` is
    replaced.
    """
    model = fit(docs, labels, id_col, text_col, label_col, max_labelled, keep_good)
    return scored(docs, model, text_col, score_col).where(F.col(score_col) >= model.cut)
