import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_fixtures import awkward, edited, empty, frame, sentence

from loomtext.llm import arrow_text, minhash
from loomtext.llm.components import connected
from loomtext.llm.exact_dedup import exact_dedup, splitters
from loomtext.llm.minhash import near_duplicates, without_near_duplicates


def normal(text):
    return None if text is None else re.sub("\r\n?", "\n", text).strip(" \t\n\f")


def test_exact_dedup_keeps_the_smallest_id_of_each_text(spark):
    best = {}
    for i, t, *_ in awkward():
        k = normal(t)
        if k not in best or (i is not None and (best[k] is None or i < best[k])):
            best[k] = i
    got = exact_dedup(frame(spark))
    assert got.columns == frame(spark).columns
    assert sorted(((normal(r.text), r.doc_id) for r in got.collect()), key=str) == sorted(best.items(), key=str)


def test_exact_dedup_keeps_texts_as_they_are(spark):
    texts = {r.doc_id: r.text for r in exact_dedup(frame(spark)).collect()}
    for i, t, *_ in awkward():
        if i in texts and i is not None:
            assert texts[i] == t


def test_half_of_the_rows_may_be_one_text(spark):
    """The sample is of rows and stays within its bound, and the ranges stay even over the distinct texts."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'hot', CONCAT('a heading that all others share ', REPEAT('x', 600), id)) AS text")
    cuts = splitters(df, df.text, 16, 500)
    assert len(cuts) == 15
    rows = [r.n for r in exact_dedup(df).selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()]
    assert sum(rows) == 10_001 and max(rows) < 2 * 10_001 / 4


def test_ties_fall_alike_at_any_partitioning(spark):
    rows = [(1, "same " if i % 2 else "same", f"s{i}", {"k": i}) for i in range(40)] + [(None, "same", "s", {})]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, m map<string, int>")
    got = {str(exact_dedup(df.repartition(n, F.rand(n))).collect()) for n in (1, 3, 7)}
    assert len(got) == 1 and "doc_id=1" in got.pop()


def test_exact_dedup_of_very_long_texts(spark):
    long = "abc def " * 500_000
    df = spark.createDataFrame([(2, long + "x"), (1, long + "y"), (3, long + "x\r\n")], "doc_id int, text string")
    assert sorted(r.doc_id for r in exact_dedup(df).collect()) == [1, 2]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(empty(spark)).collect() == []


def shingles(text, n=minhash.SHINGLE_WORDS):
    words = [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", text or "") if w]
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_groups(rows, threshold=minhash.THRESHOLD):
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    sets = [(i, s) for i, s in sets if s]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if a != b and len(s & t) >= threshold * len(s | t):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {(i, find(i)) for i in up if find(i) != i}


def test_near_duplicates_are_the_components_of_brute_force(spark):
    got = near_duplicates(frame(spark))
    assert got.columns == ["doc_id", "keep_doc_id"]
    assert {tuple(r) for r in got.collect()} == brute_groups(awkward())


def test_near_duplicates_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    got = {tuple(r) for r in near_duplicates(docs).collect()}
    assert len(want) > 10 and len(got & want) >= 0.9 * len(want)
    assert {a for a, _ in got} <= {a for a, _ in want}


def test_without_near_duplicates_keeps_one_of_each_group_and_all_else(spark):
    gone = {i for i, _ in brute_groups(awkward())}
    left = without_near_duplicates(frame(spark))
    assert left.columns == frame(spark).columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, *_ in awkward() if i not in gone), key=str)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(empty(spark)).collect() == []
    assert without_near_duplicates(empty(spark)).collect() == []


def test_links_through_a_third_document_survive_the_stars(spark):
    """A chain in which the ends are unlike: the smallest id is near only one of them."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[a : a + 100]), "en", "s", 1) for i, a in enumerate((60, 40, 20, 0))]
    assert {tuple(r) for r in near_duplicates(frame(spark, rows)).collect()} == brute_groups(rows) == {(1, 0), (2, 0), (3, 0)}


def test_a_hot_bucket_of_several_groups_is_resolved(spark):
    """Everyone shares buckets with everyone, yet links lie along chains whose ends are unlike; small tasks salt them."""
    rng = random.Random(21)
    rows = []
    for g in range(4):
        words = sentence(rng, 60 + 12 * 40).split()
        rows += [(200 * g + i, " ".join(words[12 * i : 12 * i + 60])) for i in range(40)]
    rng.shuffle(rows)
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    wanted = brute_groups([(i, t) for i, t in rows])
    plain, salt = minhash.near_duplicates, minhash.SALT_PAIRS
    try:
        minhash.SALT_PAIRS = 16
        got = {tuple(r) for r in plain(docs, bands=96, rows=1).collect()}
    finally:
        minhash.SALT_PAIRS = salt
    assert got == wanted and len(wanted) >= 100


def shuffled(spark):
    """Bytes that this session's tasks have written for shuffles so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.length()))


def test_only_sets_of_pairs_are_shuffled(spark, tmp_path):
    """A few pairs among many sets: what is compared moves, the rest stays where it is."""
    rng = random.Random(5)
    rows = [(i, sorted(rng.getrandbits(62) for _ in range(400))) for i in range(2000)]
    rows += [(5000, rows[7][1][:300]), (5001, rows[8][1][:100])]
    spark.createDataFrame(rows, "id int, s array<bigint>").write.parquet(str(tmp_path / "sets"))
    spark.createDataFrame([(7, 5000), (8, 5001), (1, 2)], "a int, b int").write.parquet(str(tmp_path / "pairs"))
    sets, pairs = spark.read.parquet(str(tmp_path / "sets")), spark.read.parquet(str(tmp_path / "pairs"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert [tuple(r) for r in minhash.verified(pairs, sets, 0.55).collect()] == [(7, 5000)]
        assert shuffled(spark) - before < 200_000  # all sets are 6.4 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("most", [minhash.BROADCAST_BYTES, 0])
def test_later_rounds_read_only_the_sets_of_open_buckets(spark, monkeypatch, most):
    """Groups whose buckets are their own are done with after the stars, however much else is compared; nothing is broadcast at 0."""
    rng = random.Random(22)
    words = [f"w{i}" for i in range(60 + 18 * 20)]
    rows = [(i, " ".join(words[18 * i : 18 * i + 60])) for i in range(20)]  # neighbours share buckets, but are too unlike
    for g in range(30):
        text = " ".join(f"g{g}w{k}" for k in range(50))
        rows += [(100 + 2 * g, text), (101 + 2 * g, text + " end")]
    rng.shuffle(rows)
    seen, plain = [], minhash.verified

    def verified(pairs, sets, threshold):
        seen.append({r.id for r in sets.select("id").collect()})
        return plain(pairs, sets, threshold)

    monkeypatch.setattr(minhash, "verified", verified)
    monkeypatch.setattr(minhash, "BROADCAST_BYTES", most)
    got = {tuple(r) for r in near_duplicates(frame(spark, [(i, t, "en", "s", 1) for i, t in rows]), bands=96, rows=1).collect()}
    assert got == brute_groups(rows) == {(101 + 2 * g, 100 + 2 * g) for g in range(30)}
    assert len(seen) >= 2 and seen[0] == {i for i, _ in rows}
    # The 20, and hardly a group: shingles that fall on one place of the permutation may put one into an open bucket.
    assert all(0 < len(ids) <= 24 for ids in seen[1:])


def test_without_the_shortcut_nothing_changes(spark):
    assert {tuple(r) for r in near_duplicates(frame(spark), shortcut=False).collect()} == brute_groups(awkward())


def test_circulant_signatures_estimate_jaccard():
    scatter, windows = minhash.permutations(1 << 16, 128, 7)
    assert sorted(scatter) == list(range(1 << 16)) and (windows[5][:10] == windows[4][1:11]).all()
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 44, 600, dtype=np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 1 << 44, 200, dtype=np.uint64)])
    same = (minhash.signature(a, scatter, windows) == minhash.signature(b, scatter, windows)).mean()
    assert abs(same - 400 / 800) < 0.15


def test_shingles_do_not_depend_on_neighbouring_texts():
    texts = [t for _, t, *_ in awkward() if t is not None]
    alone = []
    for t in texts:
        for _, s, b in minhash.shingle_sets(pa.array([t]), 3):
            alone.append(s[b[0] : b[1]].tolist())
    together = []
    for _, s, b in minhash.shingle_sets(pa.array(texts), 3):
        together += [s[b[i] : b[i + 1]].tolist() for i in range(len(b) - 1)]
    assert alone == together
    assert [len(x) for x in alone] == [len(shingles(t)) for t in texts]


def test_words_are_hashed_over_all_their_bytes():
    long = "x" * 5000
    a, b = arrow_text.word_hash(long + "a"), arrow_text.word_hash(long + "b")
    assert a != b and arrow_text.word_hash(long) != arrow_text.word_hash(long + "\0")


def test_components(spark):
    edges = [(1, 2), (3, 2), (4, 3), (10, 11), (12, 11), (5, 5), (30, 20), (20, 30)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20, 30: 20}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    assert {r.root for r in connected(chain).collect()} == {0}
    assert connected(chain.where("a < 0")).collect() == []


@pytest.mark.parametrize("ids", [["b", "a", "c"]])
def test_ids_may_be_strings(spark, ids):
    df = spark.createDataFrame([(i, "the very same words here") for i in ids], "k string, body string")
    assert {tuple(r) for r in near_duplicates(df, "k", "body").collect()} == {("b", "a"), ("c", "a")}
    assert [r.k for r in exact_dedup(df, "k", "body").collect()] == ["a"]


def test_group_sizes(spark):
    groups = defaultdict(set)
    for r in near_duplicates(frame(spark)).collect():
        groups[r.keep_doc_id].add(r.doc_id)
    assert groups[0] >= {25, 26, 27, 28}


def test_other_texts_of_an_id_whose_text_is_repeated_keep_their_neighbours(spark):
    rng = random.Random(12)
    one, two = sentence(rng, 80), sentence(rng, 80)
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in ((1, one), (2, one), (2, two), (3, edited(rng, two, 0.02)))])
    assert {(r.doc_id, r.keep_doc_id) for r in minhash.near_duplicates(docs).collect()} == {(2, 1), (3, 1)}
