"""Sources, caches and streams."""

from datetime import datetime

from pyspark.sql import functions as F

from loomtext.functions.text import token_count
from loomtext.operators import filters, lookup, report
from loomtext.plans import adaptive
from loomtext.sources import cache, files
from loomtext.streaming import changes as stream


def test_listing_decodes_and_leaves_git_out(spark, tmp_path):
    for name, data in {"a/x.py": b"ok \xff\xfe!", "a/.git/y.py": b"no", "Dockerfile": b"FROM x", "b.PY": b"", "c.txt": b"t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    df = files.with_text(files.scanned(files.listing(spark, str(tmp_path)), [".py"], filters.FilterNode()), str(tmp_path))
    assert {r.rel_path: r.text for r in df.collect()} == {"a/x.py": "ok !", "Dockerfile": "FROM x", "b.PY": ""}
    outside = files.external(files.listing(spark, str(tmp_path)), ["../c.*"], "a")
    assert [r.rel_path for r in outside.select("rel_path").collect()] == ["c.txt"]
    assert [r.rel_path for r in files.listing(spark, f"file://{tmp_path}", "*.t?t").collect()] == ["c.txt"]


def test_directories_that_filters_rule_out_are_not_listed(spark, tmp_path, monkeypatch):
    names = [f"{top}/{mid}/f{i}.py" for top in ("src", "docs", "deep") for mid in ("a", "b", "c") for i in range(3)]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "docs" / "locked").mkdir()
    tree = filters.FilterNode("block", block=["/docs/"], children={"src": filters.FilterNode("allow", ["/a/"])})
    for fanout in (1, 3, 256):
        monkeypatch.setattr(files, "FANOUT", fanout)
        assert sorted(r.rel_path for r in files.listing(spark, str(tmp_path)).collect()) == sorted(names)
        descend = files.pruning(tree)
        listed = {r.rel_path for r in files.listing(spark, str(tmp_path), descend=descend).collect()}
        assert not any(p.startswith("docs/") for p in listed) and {n for n in names if n.startswith(("src/a", "deep"))} <= listed
        inner = {r.rel_path for r in files.listing(spark, str(tmp_path), descend=files.pruning(filters.FilterNode("allow", ["/b/"]), "deep")).collect()}
        assert inner and all(p.startswith("deep/b/") for p in inner)


def test_store_computes_each_key_once(spark, tmp_path):
    store, calls = cache.Store(spark, str(tmp_path / "c")), []

    def compute(df):
        calls.append([r.key for r in df.collect()])
        return df.select("key", token_count(F.col("t")).alias("n"))

    df = spark.createDataFrame([("k1", "a b"), ("k1", "a b"), ("k2", "c")], "key string, t string")
    assert sorted(r.n for r in store.through("tokens", df, compute).collect()) == [1, 2, 2]
    store.through("tokens", df.union(spark.createDataFrame([("k3", "d")], df.schema)), compute).collect()
    assert sorted(calls[0]) == ["k1", "k2"] and calls[1] == ["k3"]
    assert store.snapshot()["tokens"][0] > 0
    store.rebuild()
    assert store.snapshot() == {}


def test_keys_hold_label_and_options(spark):
    row = spark.range(1).select(*[cache.processed_key(F.lit("t"), F.lit(label), o).alias(f"k{i}") for i, (label, o) in enumerate([("a", {"x": 1}), ("b", {"x": 1}), ("a", {"x": 2}), ("a", {"x": 1})])]).first()
    assert len(set(row)) == 3 and row.k0 == row.k3


def test_counted_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "")], "i int, text string")
    assert sorted((r.i, r.tokens) for r in cache.counted_once(df, token_count).collect()) == [(1, 2), (2, 2), (3, 0)]


def test_reports_of_nothing_and_negative_savings(spark):
    none = spark.createDataFrame([], "path string, size_bytes bigint, tokens_raw bigint, tokens_processed bigint")
    t = report.totals(none, none.selectExpr("tokens_raw AS tokens_rendered")).first()
    assert t.savedPct == t.ctxShare == 0.0 and t.renderedOverheadTokens == 0
    some = spark.createDataFrame([("a", 3, 10, 12), ("b", 0, 0, 0)], none.schema)
    rows = {r.path: r for r in report.file_rows(some, 100).collect()}
    assert rows["a"].savedTokens == -2 and abs(rows["a"].savedPct + 20) < 1e-9 and rows["a"].promptShare == 100.0 and rows["b"].savedPct == 0.0


def test_meta_projection_and_options(spark):
    df = spark.createDataFrame([({"a": "3", "b": "true", "c": "2.9", "d": "x"},)], "m map<string,string>")
    assert df.select(lookup.numeric_meta(F.col("m")).alias("n")).first().n == {"a": 3, "b": 1, "c": 2}
    merged = df.select(lookup.merged_options(F.col("m"), F.create_map(F.lit("a"), F.lit("9"))).alias("n")).first().n
    assert merged["a"] == "9" and merged["d"] == "x"
    assert lookup.resolved_options({"a": 1}, [("yes", {"a": 2}), ("no", {"a": 3})], lambda c: c == "yes") == {"a": 2}


def test_model_merge_and_adapters():
    parent = adaptive.Model.parse({"mode-sets": {"m": {"title": "P", "modes": {"a": "A", "b": {"tags": ["x"]}}}}})
    child = adaptive.Model.parse({"mode-sets": {"m": {"title": "C", "modes": {"b": "B2"}}}, "tag-sets": {"t": {"tags": {"q": "Q"}}}})
    out = parent.merged(child)
    assert out.modes["m"].title == "C" and out.modes["m"].modes["b"].title == "B2" and out.modes["m"].modes["a"].title == "A" and out.tagsets == {"t": {"q"}}
    assert adaptive.merged_adapters({"p": {"a": 1, "when": [1]}}, {"p": {"a": 2, "when": [2]}, "q": {}}) == {"p": {"a": 2, "when": [1, 2]}, "q": {}}


def test_streams(spark, tmp_path):
    t = datetime(2024, 1, 1, 10)
    rows = [("a.py", t, "x", "one two"), ("a.py", t, "x", "one two"), ("b.py", datetime(2024, 1, 1, 10, 30), "x", "three"), ("c.py", datetime(2024, 1, 1, 12), "y", "four")]
    df = spark.createDataFrame(rows, "rel_path string, modified timestamp, lang string, text string")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    changed = spark.createDataFrame([("a.py",), ("b.py",)], "rel_path string")

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.rel_path for r in run(stream.affected(stream.latest(source), changed), "hit", "append")) == ["a.py", "b.py"]
    sums = {(r.lang, r.files, r.tokens) for r in run(stream.running_totals(source, "lang"), "sums", "complete")}
    assert sums == {("x", 3, 5), ("y", 1, 1)}
