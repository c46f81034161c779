import os
import re

import oracle
import pytest

import __spark_entry__ as entry
from loomtext.functions import markdown
from loomtext.operators.code import frames, transforms
from loomtext.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLE_SQL:
        assert oracle.differences(df, oracle.connection(sf), catalogue.ORACLE_SQL[name]) == []
    else:
        assert df.count() > 0


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The tables with documents that are empty or of one blank line, have no text, language or source, or are in a group of their own."""
    out = tmp_path_factory.mktemp("odd")
    for t in oracle.TABLES:
        os.symlink(f"{sf}/{t}.parquet", out / f"{t}.parquet") if t != "documents" else None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(10**6 + i, text, lang, source, len(text or "")) for i, (text, lang, source) in enumerate([("", "en", "void"), ("", "en", "void"), ("", "fr", "void"), ("", "es", "void"), ("\n", "de", "void"), ("", "de", "wiki"), ("a\r\n\nb", "en", "wiki"), ("x", None, "wiki"), ("x", "de", None), (None, "en", "wiki")])]
    docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).coalesce(1).write.parquet(str(out / "documents.parquet"))
    return str(out)


@pytest.mark.parametrize("name", ["plural_placeholder", "section_omission"])
def test_odd_documents_count_as_in_sql(spark, odd, name):
    assert oracle.differences(catalogue.QUERIES[name](spark, odd), oracle.connection(odd), catalogue.ORACLE_SQL[name]) == []


def test_outlines_are_cleaned_once(spark, sf):
    """The expression that cleans a line was evaluated for each use of the line, five times."""
    plan = catalogue.heading_shift(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_modules_are_made_without_a_shuffle(spark, sf):
    assert "Exchange" not in catalogue.sources(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and abs(sum(r.promptShare for r in rows) - 100) < 1e-9


def test_registered_names():
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts_without_sql_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    text = {r.doc_id: r.text for r in docs}
    want = {i: markdown.slug(t) for i, t in text.items()}
    for name in ("slugs", "slugify"):
        assert {r.doc_id: r.slug for r in catalogue.QUERIES[name](spark, sf).collect()} == want
    paths = [f"tree/all/{r.source}/{r.doc_id}" for r in docs]
    assert [r.prefix for r in catalogue.QUERIES["common_prefix"](spark, sf).collect()] == [os.path.commonpath(paths)]


def test_budgets_against_the_ladder_by_hand(spark, sf, monkeypatch):
    """Each module is reduced by the first step of the ladder that brings it within 200 tokens, or by the one that brings it nearest."""
    seen = []
    made = frames.processed_files
    monkeypatch.setattr(frames, "processed_files", lambda files: seen.append(files) or made(files))
    got = {r.rel_path: (r.before, r.after) for r in catalogue.QUERIES["code_budget"](spark, sf).collect()}
    for r in seen[0].collect()[:40]:
        o = transforms.options({"budget": {"max_tokens_per_file": 200}})
        o["placeholders"] = {"ratio": 0.0, "least": 1}
        sizes = [transforms.count_tokens(transforms.reduced(transforms.Source(r.text, "python"), step)[0]) for step in transforms.ladder(o)]
        first = next((k for k, n in enumerate(sizes) if n <= 200), None)
        want = min(sizes) if first is None else sizes[first]
        assert got[r.rel_path] == (transforms.count_tokens(r.text), want)


def test_literals_are_made_of_all_words(spark, sf, monkeypatch):
    seen = []
    made = frames.processed_files
    monkeypatch.setattr(frames, "processed_files", lambda files: seen.append(files) or made(files))
    catalogue.QUERIES["code_literals"](spark, sf)
    lists = {r.rel_path: r.text for r in seen[0].collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.split(" +", re.sub("[^A-Za-z ]", "", r.text))
        assert lists[f"{r.doc_id}.py"] == "X = [" + ", ".join(f'"{w}"' for w in words) + "]\n"
