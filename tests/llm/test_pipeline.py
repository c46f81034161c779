"""The pipeline against the stages' own brute force, on the smallest tables; and the queries against their SQL."""

from collections import Counter

import oracle
import pytest
from llm_fixtures import awkward, empty, frame
from test_dedup import brute_groups, normal

import corpus_pipeline
from loomtext.llm import arc, mixing, queries, token_counts


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == first.columns and out.dtypes == first.dtypes, name
        docs = spark.createDataFrame(out.collect(), first.schema)
        seen[name] = docs.collect()
    good, single, apart, mixed = seen.values()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.95 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.3 * sum(1 - q for q in labels.values())
    best = {}
    for r in good:
        k = normal(r.text)
        best[k] = min(best.get(k, r.doc_id), r.doc_id)
    assert {r.doc_id for r in single} == set(best.values())
    gone = {i for i, _ in brute_groups([(r.doc_id, r.text) for r in single])}
    assert {r.doc_id for r in apart} == {r.doc_id for r in single} - gone
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in apart}
    few = spark.createDataFrame(apart, first.schema)
    rates = {r.doc_id: r.rate for r in mixing.rated(few, queries.labelled_domains(few, spark.read.parquet(f"{sf}/labels.parquet")), queries.TARGETS).collect()}
    taken = Counter(r.doc_id for r in mixed)
    assert all(int(rate) <= taken[i] <= -int(-rate // 1) for i, rate in rates.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    encoder, _ = token_counts.encoding(open(token_counts.VOCABULARY, "rb").read())
    sizes = {r.doc_id: len(encoder.encode_ordinary(r.text)) for r in mixed}
    assert check_packs(packed) == Counter({i: taken[i] * n for i, n in sizes.items()})
    assert check_packs(corpus_pipeline.run(spark, sf).collect()) == check_packs(packed)


def check_packs(rows):
    """Packs hold at most 2048 tokens without gaps or overlaps. Returns the tokens of each document."""
    packs, sizes = {}, Counter()
    for r in rows:
        sizes[r.doc_id] += r.length
        if r.pack_id is not None:
            packs.setdefault(r.pack_id, []).append((r.pack_offset, r.length))
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sizes


def test_stages_take_awkward_tables(spark, sf):
    """Nulls, blanks, ties, repeated rows, a long text and clashing columns, through every stage alone."""
    docs = frame(spark)
    labels = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert labels & {i for i, *_ in awkward()}
    out = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    got = {name: df.collect() for name, df in out.items()}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert out[name].columns == docs.columns and out[name].dtypes == docs.dtypes, name
        assert {str(r) for r in got[name]} <= {str(r) for r in docs.collect()}, name
    good, single, apart, mixed, packed = got.values()
    assert all((r.text or "").strip() for r in good)
    assert len(single) == len({normal(t) for _, t, *_ in awkward()})
    gone = {i for i, _ in brute_groups(awkward())}
    assert Counter(r.doc_id for r in apart) == Counter(i for i, *_ in awkward() if i not in gone)
    assert sum(r.text is None for r in mixed) == sum(t is None for _, t, *_ in awkward())
    assert check_packs(packed).keys() == {i for i, *_ in awkward()} and any(r.doc_id is None for r in packed)


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).collect() == []
        docs = docs.where("doc_id < 3")
    assert empty(spark).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf), oracle.connection(sf), queries.ORACLE_SQL[name]) == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_warc_records_hold_their_blocks(spark, sf):
    rows = queries.QUERIES["op1_arc_to_warc"](spark, sf).collect()
    html = {r.url: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert sum(r.warc_type == "response" for r in rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r.problem is None for r in rows)
    assert all(len(r.block) == r.content_length and arc.digest(bytes(r.block)) == r.block_digest for r in rows)
    assert all(bytes(r.block).endswith(html[r.target_uri].encode()) for r in rows if r.warc_type == "response")
