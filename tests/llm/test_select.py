"""Quality, mixing, packing, toxicity."""

import random
import re
import unicodedata
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import awkward, empty, frame, sentence

from loomtext.llm import arrow_text, mixing, packing, quality, queries, toxicity
from loomtext.llm.storage import fresh


def junk(rng, n):
    return " ".join(w + rng.choice(["$$$", "%%%", "&&&"]) for w in sentence(rng, n).split())


def labelled(seed=4, n=300):
    rng = random.Random(seed)
    rows = [(1000 + i, junk(rng, 40) if i % 4 == 0 else sentence(rng, rng.randint(20, 80)), "en", "s", 1) for i in range(n)]
    return rows, [(i, int((i - 1000) % 4 != 0)) for i, *_ in rows]


def test_rules_learn_and_compile_to_what_numpy_says(spark):
    rows, labels = labelled()
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality.fit(docs, lab)
    assert 0 < len(model.rules) < 60
    scores = {r.doc_id: r.quality_score for r in quality.scored(docs, model).collect()}
    from pyspark.sql import functions as F

    stats = docs.select("doc_id", *[c.cast("double").alias(k) for k, c in quality.statistics(F.col("text")).items()]).collect()
    want = model.score_array(np.array([list(r)[1:] for r in stats], float))
    assert np.allclose([scores[r.doc_id] for r in stats], want)


def test_quality_holds_on_documents_it_has_not_seen(spark):
    rows, labels = labelled()
    new, truth = labelled(seed=99)
    docs = frame(spark, rows + [(i + 5000, *r) for i, *r in new])
    kept = {r.doc_id for r in quality.good_documents(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    right = sum((i + 5000 in kept) == bool(q) for i, q in truth)
    assert right >= 0.97 * len(truth)
    assert sum(i + 5000 in kept for i, q in truth if q) >= 0.98 * sum(q for _, q in truth)


def plain_tree(x, cuts, grad, hess, rows, depth, tests, found):
    """A tree by trying every cut, row by row."""
    if depth == 0 or len(rows) < 20:
        return {}
    g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    best = (1e-6, None)
    for j, bounds in enumerate(cuts):
        scored = []
        for b in bounds:
            low = [i for i in rows if x[i, j] <= b]
            gl, hl = sum(grad[i] for i in low), sum(hess[i] for i in low)
            few = len(low) < 5 or len(rows) - len(low) < 5
            scored.append(-1 if few else gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1))
        if scored and max(scored) > best[0] + 1e-12:
            best = (max(scored), (j, bounds[scored.index(max(scored))]))
    if best[1] is None:
        return {}
    j, b = best[1]
    for above in (True, False):
        path = (*tests, (j, above, float(b)))
        found.append(path)
        plain_tree(x, cuts, grad, hess, [i for i in rows if (x[i, j] > b) == above], depth - 1, path, found)
    return found


def test_a_tree_takes_the_best_cut_at_every_node():
    rng = np.random.default_rng(11)
    x = rng.random((150, 3)).round(2)
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 12))) for j in range(3)]
    grad, hess = y - 0.5, np.full(150, 0.25)
    found = []
    quality._tree(x, cuts, grad, hess, np.arange(150), 3, (), found)
    assert [r.tests for r in found] == plain_tree(x, cuts, grad, hess, list(range(150)), 3, (), [])


def test_lasso_weights_meet_the_conditions_of_the_optimum():
    """Every weight's slope is the penalty against its sign, and no more than the penalty where the weight is 0."""
    rng = np.random.default_rng(3)
    r = (rng.random((400, 12)) > 0.5).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1] + 0.5)))).astype(float)
    w, b = quality.lasso_logistic(r, y, penalty=5e-3, steps=6000)
    p = 1 / (1 + np.exp(-(r @ w + b)))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    slope = r.T @ (weight * (y - p))
    assert abs((weight * (y - p)).sum()) < 1e-4 and (w == 0).any() and (w != 0).any()
    assert np.allclose(slope[w != 0], 5e-3 * np.sign(w[w != 0]), atol=1e-4) and (np.abs(slope[w == 0]) <= 5e-3 + 1e-4).all()


def plain_statistics(text):
    words, lines = re.split(r"\s+", text.strip(" ")), text.split("\n")
    letters = lambda keep: sum(keep(c) for c in text) / max(1, len(text))
    said = re.sub(r"(?<!\S)(\S+)\s(?=\1(?!\S))", "", text)
    return [
        np.log1p(len(text)), len(text) / len(words), len(set(words)) / len(words), len(set(words)) / len(words) ** 0.5, (len(text) - len(said)) / max(1, len(text)),
        letters(lambda c: unicodedata.category(c) == "Lu"), letters(lambda c: unicodedata.category(c)[0] == "N"),
        letters(lambda c: not (unicodedata.category(c)[0] in "LN" or c in " \t\n\x0b\f\r.,;:!?'\"()-")), letters(lambda c: c in "!?"), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
    ]


def test_quality_against_brute_force(spark, sf):
    """Statistics, sample and cut again in plain Python on the smallest tables; the fit of the arrays is tested above."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = {r.doc_id: plain_statistics(r.text) for r in docs.collect()}
    rows = sorted((r.doc_id, r.quality, float(r.held), *stats[r.doc_id]) for r in labels.selectExpr("doc_id", "quality", "pmod(xxhash64(doc_id, 1), 5) = 0 AS held").collect())
    data = np.array(rows, float)
    model = quality.fit_arrays(data[:, 3:], data[:, 1], held=data[:, 2] == 1)
    want = dict(zip(stats, model.score_array(np.array(list(stats.values()))), strict=True))
    blank = {r.doc_id for r in docs.collect() if not r.text.strip()}
    got = {r.doc_id: r.quality_score for r in quality.good_documents(docs, labels).collect()}
    assert got.keys() == {i for i, s in want.items() if s >= model.cut and i not in blank}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_quality_of_very_long_texts(spark):
    rows, labels = labelled()
    long = [(9001, "same " * 400_000, "en", "s", 1), (9002, "A" * 3_000_000, "en", "s", 1), (9003, sentence(random.Random(1), 300_000), "en", "s", 1)]
    got = {r.doc_id for r in quality.good_documents(frame(spark, rows + long), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert 9003 in got


def test_quality_of_awkward_documents(spark):
    rows, labels = labelled()
    lab = spark.createDataFrame([*labels, (None, 1), (1000, None), (1001, 1), (1001, 1), (77777, 0)], "doc_id bigint, quality int")
    docs = frame(spark, awkward() + rows)
    out = quality.good_documents(docs, lab)
    assert out.columns == [*[c for c in docs.columns if c != "quality_score"], "quality_score"]
    got = Counter(r.text for r in out.collect())
    assert got[None] == got[""] == got[" \n\t "] == 0
    third = awkward()[3][1]
    assert got[third] in (0, 3)
    assert quality.good_documents(empty(spark), lab).collect() == []
    everything = quality.good_documents(docs, lab.where("quality > 5")).count()
    assert everything == sum(bool((t or "").strip()) for _, t, *_ in awkward() + rows)


def simulate(lengths, capacity):
    """Document by document: the open pack with the most room."""
    room = []
    for n in sorted(lengths, reverse=True):
        if room and max(room) >= n:
            room[room.index(max(room))] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(5))
def test_patterns_are_shortest_pack_first(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 50, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 400))]
    found = packing.patterns(Counter(lengths), capacity)
    assert sorted(capacity - sum(p) for n, p in found for _ in range(n)) == simulate(lengths, capacity)
    assert Counter(x for n, p in found for x in p * n) == Counter(lengths)


def test_patterns_refuse_bad_lengths():
    with pytest.raises(ValueError):
        packing.patterns({9: 1}, 8)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_slots_hold_each_rank_once(spark, broadcast, monkeypatch):
    """Packs from given lengths, with the slots broadcast and with them joined by blocks of ranks."""
    monkeypatch.setattr(packing, "BROADCAST_SLOTS", broadcast)
    monkeypatch.setattr(packing, "RANK_BLOCK", 7)
    rng = random.Random(6)
    sizes = [rng.choice([1, 1, 1, 2, 3, 5, 16, 40]) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id int, size int")
    rows = packing.packed(docs, 16, length=docs.size).collect()
    taken = Counter((r.pack_id, r.pack_offset + k) for r in rows for k in range(r.length))
    assert max(taken.values()) == 1 and sum(taken.values()) == sum(sizes)
    packs = Counter(p for p, _ in taken)
    assert max(packs.values()) <= 16 and sorted(packs) == list(range(len(packs)))
    assert sorted(16 - n for n in packs.values()) == simulate([r.length for r in rows], 16)


def test_packs_hold_every_word_once_and_never_overflow(spark):
    docs = frame(spark)
    out = packing.packed(docs, capacity=128)
    rows = out.collect()
    sizes = Counter()
    for i, t, *_ in awkward():
        sizes[i] += len((t or "").split())
    have = Counter()
    for r in rows:
        have[r.doc_id] += r.length
    assert +have == +sizes
    packs = {}
    for r in rows:
        assert (r.pack_id is None) == (r.length == 0)
        if r.length:
            packs.setdefault(r.pack_id, []).append((r.pack_offset, r.length))
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert sorted(packs) == list(range(len(packs)))
    pieces = [r.length for r in rows if r.length]
    assert sorted(128 - sum(n for _, n in p) for p in packs.values()) == simulate(pieces, 128)
    assert len(rows) == sum(max(1, -(-len((t or "").split()) // 128)) for _, t, *_ in awkward())
    assert packing.packed(empty(spark)).collect() == []


def test_pieces_of_a_document_follow_each_other(spark):
    rows = packing.packed(frame(spark), capacity=100).where("doc_id = 42").collect()
    assert len(rows) == 600 and sorted(r.begin for r in rows) == list(range(0, 60_000, 100))


LANGUAGES = {"x": "abcdef", "y": "ghijkl", "z": "mnopqr"}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def languages(seed=2, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choices("xyz", (6, 3, 1))[0]
        both = speech(rng, lang, 60) if i % 10 else speech(rng, "x", 30) + " " + speech(rng, "y", 30)
        rows.append((i, both, lang, "s", 1))
    return rows


def test_rates_bring_totals_to_their_targets(spark):
    rows = languages()
    docs = frame(spark, rows)
    lab = docs.select("doc_id", docs.lang.alias("domain")).where("doc_id % 10 <> 0 AND doc_id % 3 <> 0")
    out = mixing.rated(docs, lab, {"x": 0.3, "y": 0.5, "z": 0.2})
    assert out.columns == [*[c for c in docs.columns if c != "rate"], "rate"]
    got = out.collect()
    assert all(r.rate >= 0 for r in got)
    total = sum(60 * r.rate for r in got)
    assert abs(total - 60 * len(rows)) < 0.02 * 60 * len(rows)
    for lang, share in (("x", 0.3), ("y", 0.5), ("z", 0.2)):
        have = sum(r.rate * (1.0 if r.lang == lang else 0.0) if r.doc_id % 10 else r.rate * (0.5 if lang in "xy" else 0) for r in got) / len(rows)
        assert abs(have - share) < 0.02, (lang, have)


def parts(spark, p, n):
    return spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(p, n, strict=True)], "p array<double>, n bigint")


@pytest.mark.parametrize("want", [[0.05, 0.05, 0.9], [0.2, 0.7, 0.1], [0.6, 0.3, 0.1]])
def test_projected_gradient_finds_the_constrained_minimum(spark, want):
    """Against a plain long run of projected gradient over all documents."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([7, 2, 1], 60)
    n = rng.integers(1, 50, 60)
    w, want = n / n.sum(), np.array(want)
    metric = np.linalg.inv(p.T @ (p * w[:, None]))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = [mixing.solve(parts(spark, p, n), want, float(n.sum()), every).replay(p)[0] for every in (5, 1000)]
    assert np.allclose(*got)
    r = np.ones(60)
    for _ in range(60_000):
        r = np.maximum(0, r - p @ metric @ ((r * w) @ p - want))

    def loss(r):
        return ((r * w) @ p - want) @ metric @ ((r * w) @ p - want)

    assert (got[0] >= 0).all() and loss(got[0]) <= loss(r) + 1e-6


@pytest.mark.parametrize("share", [10, 2, 1])
def test_targets_of_rare_domains_are_met(spark, share):
    """Domains of one posterior each, the last with ``share`` thousandths of the tokens, and some documents of both it and another."""
    n, want = np.array([590, 200, 200 - share, share, 10]), np.array([0.5, 0.2, 0.2, 0.1])
    p = np.vstack([np.eye(4), [0.999, 0, 0, 0.001]])
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rate = mixing.solve(parts(spark, p, n), want, float(n.sum())).replay(p)[0]
    assert np.abs((rate * n) @ p / n.sum() - want).max() <= mixing.TOLERANCE


def test_targets_out_of_reach_are_reported(spark):
    with pytest.warns(UserWarning, match="not met"):
        mixing.solve(parts(spark, [[0.6, 0.4, 0], [0.4, 0.6, 0]], [10, 30]), np.array([0.1, 0.9, 0.0]), 40.0)
    with pytest.warns(UserWarning, match="not met"):
        mixing.solve(parts(spark, [[1, 0], [1, 0]], [10, 30]), np.array([0.5, 0.5]), 40.0)


def test_the_whole_operator_against_brute_force(spark, sf):
    """Counts, calibration, posteriors and totals again, a text at a time, on the smallest tables."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lab = queries.labelled_domains(docs, labels)
    domains = list(queries.TARGETS)
    halves = {r.doc_id: (r.domain, r.half) for r in lab.selectExpr("doc_id", "domain", "pmod(xxhash64(doc_id, 1), 2) AS half").collect()}
    texts = {r.doc_id: (r.text or "").lower().encode() for r in docs.collect()}

    def grams(b):
        wide = b + b"  "
        return [(int.from_bytes(wide[i : i + 3]) * 2654435761 & 0xFFFFFFFF) >> (32 - mixing.FEATURE_BITS) for i in range(len(b))]

    sums = np.zeros((4, 1 << mixing.FEATURE_BITS))
    for i, (domain, half) in halves.items():
        if half == 0:
            np.add.at(sums[domains.index(domain)], grams(texts[i]), 1)
    weights = np.log((sums + 0.5) / (sums.sum(axis=1, keepdims=True) + 0.5 * sums.shape[1])).astype(np.float32).astype(float)

    def means(b):
        m = weights[:, grams(b)].mean(axis=1)
        return m - m.mean()

    held = sorted((domains.index(d), means(texts[i]).tolist()) for i, (d, half) in halves.items() if half == 1)
    slope, bias = mixing.calibrate(np.array([m for _, m in held]), np.array([y for y, _ in held]), 4)
    bias[sums.sum(axis=1) == 0] = -1e9
    ids = [i for i, b in texts.items() if b.split()]
    score = np.array([means(texts[i]) for i in ids]) @ slope + bias
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    n = np.array([len(texts[i].split()) for i in ids])
    rates = {r.doc_id: r.rate for r in mixing.rated(docs, lab, queries.TARGETS).collect()}
    rate = np.array([rates[i] for i in ids])
    assert (rate >= 0).all() and len(rates) == len(texts)
    assert np.abs((rate * n) @ p / n.sum() - np.array(list(queries.TARGETS.values()))).max() <= 3 * mixing.TOLERANCE


def test_a_text_is_scored_as_if_it_were_alone():
    texts = [t for _, t, *_ in awkward() if t is not None]
    alone = [next(mixing.trigrams(pa.array([t]))) for t in texts]
    together = np.concatenate([codes for _, codes, _, _ in mixing.trigrams(pa.array(texts))])
    assert (np.concatenate([codes for _, codes, _, _ in alone]) == together).all()


def test_mixing_awkward_documents(spark):
    docs = frame(spark)
    lab = docs.select("doc_id", docs.lang.alias("domain"))
    rates = {(r.doc_id, r.text): r.rate for r in mixing.rated(docs, lab, {"en": 1, "de": 1, "none": 1}).collect()}
    assert rates[(None, None)] == 1.0 and all(v == 1.0 for (_, t), v in rates.items() if not (t or "").strip())
    assert len(rates) == len({(i, t) for i, t, *_ in awkward()})
    alone = mixing.rated(docs, lab.where("domain = 'en'"), {"en": 1, "de": 1})
    assert {r.rate for r in alone.collect()} == {1.0}
    assert mixing.rated(empty(spark), lab, {"en": 1, "de": 1}).collect() == []
    assert mixing.mixed(empty(spark), lab, {"en": 1, "de": 1}).collect() == []
    taken = mixing.mixed(docs, lab.where("false"), {"en": 1, "de": 1})
    assert taken.columns == docs.columns and taken.count() == docs.count()


def test_copies_average_to_the_rate(spark):
    df = spark.range(4000).selectExpr("id", "id % 4 * 0.75D AS rate")
    from pyspark.sql import functions as F

    got = df.select("rate", mixing.copies(F.col("rate"), F.col("id")).alias("c")).groupBy("rate").avg("c").collect()
    assert all(abs(r.rate - r["avg(c)"]) < 0.06 for r in got)


def best_segments(scores):
    """All maximal segments by definition: the best one (first, then longest of equals is not needed), then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-12 and (best is None or s > best[2] + 1e-9):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return [*best_segments(scores[:i]), (i, j, s), *[(a + j, b + j, v) for a, b, v in best_segments(scores[j:])]]


@pytest.mark.parametrize("seed", range(30))
def test_segments_against_their_definition(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-1, 1]) * rng.random() for _ in range(rng.randint(0, 14))]
    got = toxicity.segments(np.array(scores))
    want = best_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_passages_equal_segments_over_all_words():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 30)
        hits = sorted(rng.sample(range(n), rng.randint(0, min(n, 8))))
        gains = [1 + rng.random() for _ in hits]
        full = np.full(n, -0.3)
        full[hits] = gains
        assert np.allclose(toxicity.passages(np.array(hits, int), np.array(gains), -0.3), toxicity.segments(full)) if hits else toxicity.passages(np.array(hits, int), np.array(gains), -0.3) == []


def tone(seed=8, n=600):
    rng = random.Random(seed)
    common = [sentence(rng, 1) for _ in range(400)]
    bad = ["vile", "rotten", "filthy"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(30, 90))]
        toxic = i % 5 == 0
        if toxic:
            for k in range(4):
                words.insert(10 + 2 * k, rng.choice(bad).upper() if k == 2 else rng.choice(bad))
        rows.append((i, " ".join(words) + ".", "en", "s", 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    rows, labels = tone()
    lab = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id bigint, toxic int")
    out = toxicity.toxic_documents(frame(spark, rows), lab).collect()
    want = {i for i, t in labels if t}
    assert {r.doc_id for r in out} == want
    assert all(r.p_value <= toxicity.ALPHA and r.passages for r in out)
    assert all(any(w in p.text for p in r.passages for w in ("vile", "rotten", "filthy")) for r in out)


def test_toxicity_of_awkward_documents(spark):
    rows, labels = tone()
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 0)], "doc_id bigint, toxic int")
    odd = [(None, rows[0][1], None, None, None), (7001, rows[0][1], None, None, None), (7001, rows[0][1], None, None, None), (7002, "", "en", "s", 0), (7003, None, None, None, None), (7004, "... !!", "en", "s", 1), (7005, "vile", "en", "s", 1)]
    out = Counter(r.doc_id for r in toxicity.toxic_documents(frame(spark, rows + odd), lab).collect())
    assert out[None] == 1 and out[7001] == 2 and not out[7002] and not out[7003] and not out[7004]
    assert toxicity.toxic_documents(empty(spark), lab).collect() == []
    assert toxicity.toxic_documents(frame(spark, rows), lab.where("toxic = 0")).collect() == []
    assert toxicity.toxic_documents(frame(spark, rows), lab.where("toxic = 1")).collect() == []


def test_toxic_text_is_found_in_a_corpus_that_is_nearly_clean(spark):
    rows, labels = tone(n=90)
    more, kinds = tone(seed=9, n=4000)
    rare = [x for x, (i, toxic) in zip(more, kinds, strict=True) if not toxic or i % 1000 == 0]
    lab = spark.createDataFrame([(i - 90, t) for i, t in labels], "doc_id bigint, toxic int")
    labelled = [(i - 90, *rest) for i, *rest in rows]
    out = {r.doc_id for r in toxicity.toxic_documents(frame(spark, labelled + rare), lab).collect() if r.doc_id >= 0}
    assert {0, 1000, 2000, 3000} <= out and len(out) <= 4 + 0.005 * len(rare)


def test_calibration_counts_every_segment(spark):
    """Two long runs of neutral words keep three toxic words apart."""
    word = np.array([arrow_text.word_hash("vile")], np.uint64)
    model = toxicity.Model(word, np.array([2.0]), -1.0)
    texts = spark.createDataFrame([(1, "vile " + "a b c d " * 5 + "vile " + "a b c d " * 5 + "vile")], "id bigint, text string")
    (row,) = toxicity._scan(texts, spark.sparkContext.broadcast(model), None).collect()
    assert [p.score for p in row.passages] == [2.0, 2.0, 2.0]


def test_shrunken_log_odds():
    toxic, clean = np.array([9, 3, 1, 0, 1, 20] + [1] * 40 + [0] * 360, float), np.array([0, 0, 0, 1, 9, 180] + [0] * 40 + [1] * 360, float)
    score, other = toxicity.log_odds(toxic, clean)
    assert score[0] > score[1] > score[2] > score[3] and score[1] > score[5] > score[4] and score[1] > other


def test_log_odds_against_their_definition():
    """One prior at a time, with exact gamma functions."""
    from math import exp, lgamma, log

    toxic, clean = np.array([9, 3, 0, 1, 0], float), np.array([0, 4, 30, 1, 2], float)
    assert np.allclose(toxicity._log_gamma(np.array([0.01, 0.5, 1, 3.7, 900.0])), [lgamma(x) for x in (0.01, 0.5, 1, 3.7, 900.0)])
    base = log(toxic.sum() / clean.sum())
    weights = [1 / len(toxicity.GRID)] * len(toxicity.GRID)
    prior = [toxicity.PRIOR / (1 + exp(-(base + g))) for g in toxicity.GRID]
    fits = [[lgamma(a + t) + lgamma(toxicity.PRIOR - a + c) - lgamma(toxicity.PRIOR + t + c) - lgamma(a) - lgamma(toxicity.PRIOR - a) for a in prior] for t, c in zip(toxic, clean, strict=True)]
    fits = [[exp(x - max(row)) for x in row] for row in fits]
    for _ in range(toxicity.ROUNDS):
        post = [[f * w / sum(x * y for x, y in zip(row, weights, strict=True)) for f, w in zip(row, weights, strict=True)] for row in fits]
        weights = [sum(p[j] for p in post) / len(post) for j in range(len(prior))]
    want = []
    for (t, c), row in zip(zip(toxic, clean, strict=True), fits, strict=True):
        whole = sum(f * w for f, w in zip(row, weights, strict=True))
        want.append(sum(f * w * (log((a + t) / (toxicity.PRIOR - a + c)) - base) for f, w, a in zip(row, weights, prior, strict=True)) / whole)
    assert np.allclose(toxicity.log_odds(toxic, clean)[0], want)


def test_toxic_documents_against_brute_force(spark, sf):
    """The whole operator again on the smallest tables, a document at a time, in plain Python."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    words = {r.doc_id: re.findall(r"[a-z0-9'\u0080-\U0010ffff]+", (r.text or "").lower()) for r in docs.collect()}
    kinds = {r.doc_id: (r.toxic, r.held) for r in labels.groupBy("doc_id").agg({"toxic": "max"}).selectExpr("doc_id", "`max(toxic)` AS toxic", "pmod(xxhash64(doc_id, 1), 5) = 0 AS held").collect()}
    seen = [Counter(w for i, (y, held) in kinds.items() if not held and y == k for w in set(words[i])) for k in (1, 0)]
    vocabulary = sorted({*seen[0], *seen[1]})
    toxic, clean = (np.array([c[w] for w in vocabulary], float) for c in seen)
    scores, other = toxicity.log_odds(toxic, clean)
    drift = toxicity.DRIFT + max(0.0, other, float(clean @ scores / clean.sum()))
    score = dict(zip(vocabulary, scores - drift, strict=True))
    cut = lambda i: toxicity.segments(np.array([score.get(w, other - drift) for w in words[i]]))
    calm = [i for i, (y, held) in kinds.items() if held and y == 0]
    found = np.array([s for i in calm for *_, s in cut(i)])
    floor = float(np.quantile(found, toxicity.TAIL)) if len(found) else 0.0
    excess = found[found >= floor] - floor
    decay = min(1.0, (len(excess) + 1) / (float(excess.sum()) + 1))
    scale = (len(excess) + 1) / max(1, sum(len(words[i]) for i in calm)) * np.exp(decay * floor)
    want = {}
    for i in words:
        p = {s: -np.expm1(-scale * len(words[i]) * np.exp(-decay * s)) for *_, s in cut(i)}
        if p and min(p.values()) <= toxicity.ALPHA:
            want[i] = sorted(s for s in p if p[s] <= toxicity.ALPHA)
    got = {r.doc_id: sorted({round(p.score, 9) for p in r.passages}) for r in toxicity.toxic_documents(docs, labels).collect()}
    assert want and got.keys() == want.keys() and all(np.allclose(got[i], sorted({round(s, 9) for s in want[i]})) for i in want)


def test_fresh_names():
    assert fresh(["a", "__X"], "x", "x") == ["__x_", "__x__"]
