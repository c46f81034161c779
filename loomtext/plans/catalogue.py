"""Named queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import markdown
from loomtext.functions import text as T
from loomtext.operators import conditions, filters, ignore, intervals, lookup, render, report
from loomtext.plans import adaptive, code_catalogue, more_catalogue, sections, template
from loomtext.sources import cache, changes, files
from loomtext.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of files: ``source/lang/id.md``."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return table(spark, sf_dir, "documents").withColumn("rel_path", path)


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: host and path of the URL."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$|/$", "").alias("rel_path"), "html")


_PATH = "source || '/' || lang || '/' || doc_id || '.md'"
_URL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$|/$', '')"


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {a} / ({b})::DOUBLE * 100.0 ELSE 0.0 END"


TREE = filters.FilterNode(
    "allow", ["/src1*/", "/src2/"], ["**/*7.md"],
    {"src1": filters.FilterNode("block", block=["/de/"]), "src12/en": filters.FilterNode("allow", ["*1.md", "*2.md"])},
)
_TREE_SQL = r"""(regexp_matches(p, '^src1[^/]*/.') OR starts_with(p, 'src2/')) AND NOT regexp_matches(p, '7\.md$')
    AND NOT (starts_with(p, 'src1/') AND starts_with(p, 'src1/de/'))
    AND NOT (starts_with(p, 'src12/') AND NOT starts_with(p, 'src12/en/'))
    AND NOT (starts_with(p, 'src12/en/') AND NOT regexp_matches(p, '[12]\.md$'))"""
CUT = 300
_CUT_SQL = f"CASE WHEN raw <= {CUT} THEN text ELSE regexp_replace(substr(text, 1, greatest(1, floor(length(text) * {CUT} / raw::DOUBLE))::INT), '\\s+$', '') END"


def once(df: DataFrame, **columns) -> DataFrame:
    """Adds columns as a generated row, so that the optimizer doesn't write their expressions out wherever they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def measured(docs: DataFrame) -> DataFrame:
    counted = once(docs, tokens_raw=T.token_count(F.col("text")), size_bytes=F.octet_length("text").cast("bigint"))
    cut = once(counted, processed_text=T.truncate_to_tokens(F.col("text"), CUT, F.col("tokens_raw")))
    # A text that isn't cut has been counted already.
    return cut.withColumn("tokens_processed", F.when(F.col("tokens_raw") <= CUT, F.col("tokens_raw")).otherwise(T.token_count(F.col("processed_text"))))


_MEASURED = f"""m AS (
  SELECT *, {_tokens('done')} AS processed, strlen(text) AS size
  FROM (SELECT *, {_CUT_SQL} AS done FROM (SELECT *, {_PATH} AS p, {_tokens('text')} AS raw FROM documents))
)"""


@query(f"""WITH {_MEASURED}
SELECT p AS path, size AS "sizeBytes", raw AS "tokensRaw", processed AS "tokensProcessed", raw - processed AS "savedTokens",
       CASE WHEN raw <> 0 THEN (1.0::DOUBLE - processed / raw::DOUBLE) * 100.0 ELSE 0.0 END AS "savedPct",
       {_share('processed', 'sum(processed) OVER ()')} AS "promptShare", {_share('processed', '128000')} AS "ctxShare"
FROM m WHERE {_TREE_SQL} ORDER BY path""")
def report_files(spark, sf_dir):
    docs = corpus(spark, sf_dir).where(filters.included(TREE, F.col("rel_path")))
    # The measures are written once: the total and the rows, and the order's sample, then read three numbers a file and no texts.
    stats = written(measured(docs).select(F.col("rel_path").alias("path"), "size_bytes", "tokens_raw", "tokens_processed"), "measures")
    return report.file_rows(stats).orderBy("path")


@query(f"""WITH {_MEASURED}, s AS (SELECT source, sum(processed) + 2 AS rendered FROM m GROUP BY source)
SELECT sum(size)::BIGINT AS "sizeBytes", sum(processed)::BIGINT AS "tokensProcessed", sum(raw)::BIGINT AS "tokensRaw", (sum(raw) - sum(processed))::BIGINT AS "savedTokens",
       (1.0::DOUBLE - sum(processed) / sum(raw)::DOUBLE) * 100.0 AS "savedPct", sum(processed) / 128000::DOUBLE * 100.0 AS "ctxShare",
       (SELECT sum(rendered) FROM s)::BIGINT AS "renderedTokens", ((SELECT sum(rendered) FROM s) - sum(processed))::BIGINT AS "renderedOverheadTokens"
FROM m""")
def report_totals(spark, sf_dir):
    m = measured(corpus(spark, sf_dir))
    sections = m.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("size_bytes", "tokens_raw", "tokens_processed")], (F.sum("tokens_processed") + 2).alias("tokens_rendered"))
    return report.totals(sections)


@query("""WITH u AS (SELECT doc_id, source AS section, doc_id AS ord FROM documents UNION ALL SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END, 100000000 + d.doc_id FROM documents d JOIN labels l USING (doc_id))
SELECT doc_id AS path, array_to_string(list(section ORDER BY ord), ',') AS sections FROM (SELECT DISTINCT ON (doc_id, section) * FROM u ORDER BY ord) GROUP BY doc_id""")
def report_section_usage(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first = docs.select(F.col("doc_id").alias("path"), F.col("source").alias("section"), F.col("doc_id").alias("ord"))
    kind = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    second = docs.select("doc_id").join(labels, "doc_id").select(F.col("doc_id").alias("path"), kind.alias("section"), (F.col("doc_id") + 100_000_000).alias("ord"))
    return report.file_stats(first.unionByName(second)).select("path", F.array_join("sections", ",").alias("sections"))


@query("""SELECT section, arg_max(tokens, ord) AS tokens_rendered, arg_max(chars, ord) AS size_bytes, count(*) AS uses
FROM (SELECT lang AS section, doc_id AS ord, n_chars AS chars, length(text) AS tokens FROM documents) GROUP BY section""")
def section_last_writer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return report.section_stats(docs.select(F.col("lang").alias("section"), F.col("doc_id").alias("ord"), F.length("text").cast("bigint").alias("tokens_rendered"), F.col("n_chars").alias("size_bytes")))


@query("""SELECT event_type AS key, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS value FROM events GROUP BY event_type""")
def meta_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    meta = events.select(F.create_map(F.col("event_type"), F.get_json_object("props", "$.k")).alias("meta"))
    return report.meta_summary(report.meta_entries(meta))


@query(f"""WITH {_MEASURED}, t AS (SELECT sum(processed)::BIGINT AS sections, sum(raw)::BIGINT AS final FROM m)
SELECT final AS "finalRenderedTokens", greatest(0, final - sections) AS "templateOnlyTokens", {_share('greatest(0, final - sections)', 'final')} AS "templateOverheadPct", {_share('final', '128000')} AS "finalCtxShare" FROM t""")
def context_overhead(spark, sf_dir):
    t = measured(corpus(spark, sf_dir)).agg(F.sum("tokens_processed").alias("sections"), F.sum("tokens_raw").alias("final"))
    return t.select(*report.context_block(F.col("final"), F.col("sections")))


@query("SELECT event_type AS key, sum(value) AS number, arg_max(props, event_id) AS text FROM events GROUP BY event_type")
def merged_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return report.merged_metrics(e.select(F.col("event_type").alias("key"), F.col("event_id").alias("ord"), F.col("value").alias("number"), F.col("props").alias("text")))


@query(f"SELECT p AS rel_path FROM (SELECT {_PATH} AS p FROM documents) WHERE {_TREE_SQL}")
def filter_tree(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return docs.where(filters.included(TREE, F.col("rel_path"))).select("rel_path")


@query(f"SELECT p AS rel_path FROM (SELECT {_PATH} AS p FROM documents) WHERE (starts_with(p, 'src3/') OR starts_with(p, 'src4/')) AND NOT regexp_matches(p, '/fr/')")
def filter_conditional(spark, sf_dir):
    ctx = conditions.Context({"more", "web"}, {"size": {"more", "less"}})
    node = filters.FilterNode("allow", ["/src3/"], [], {}, [("TAGONLY:size:more AND NOT tag:minimal", ["/src4/"], ["**/fr/**"]), ("tag:minimal OR scope:parent", ["/src5/"], []), ("tag:", ["/src6/"], [])])
    live = filters.conditioned(node, lambda c: conditions.evaluate(c, ctx))
    return corpus(spark, sf_dir).where(filters.included(live, F.col("rel_path"))).select("rel_path")


@query(f"SELECT page_id, p AS rel_path FROM (SELECT page_id, {_URL} AS p FROM pages) WHERE lower(regexp_extract(regexp_extract(p, '([^/]*)$', 1), '.(\\.[^./]+)$', 1)) IN ('.html', '.htm') OR regexp_extract(p, '([^/]*)$', 1) IN ('README', 'Dockerfile', 'Makefile', 'pyproject.toml')")
def filter_extension(spark, sf_dir):
    return url_paths(spark, sf_dir).where(filters.has_extension(F.col("rel_path"), [".HTML", "htm"])).select("page_id", "rel_path")


@query("SELECT doc_id, n_chars - n_chars % 2000 AS size FROM documents WHERE NOT (n_chars - n_chars % 2000 = 0 AND CASE lang WHEN 'de' THEN true WHEN 'fr' THEN false ELSE source = 'never' OR true END)")
def filter_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") - F.col("n_chars") % 2000).alias("size"))
    policy = F.when(F.col("lang") == "de", "exclude").when(F.col("lang") == "fr", "include")
    return docs.where(~filters.skips_empty(F.col("size"), True, policy)).select("doc_id", "size")


@query(f"SELECT p AS rel_path FROM (SELECT {_PATH} AS p FROM documents) WHERE p = 'src1/en' OR starts_with(p, 'src1/en/')")
def filter_scope(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.in_scope(F.col("rel_path"), "src1/en")).select("rel_path")


@query("SELECT source, count(*) > 0 AND bool_and(CASE WHEN lang = 'en' THEN 'markdown' WHEN lang = 'fr' THEN '' WHEN source = 'src0' THEN lang ELSE 'markdown' END IN ('markdown', '')) AS doc_only FROM documents GROUP BY source")
def filter_doc_only(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "markdown").when(F.col("lang") == "fr", "").when(F.col("source") == "src0", F.col("lang")).otherwise("markdown")
    return docs.groupBy("source").agg(lookup.is_doc_only(kind).alias("doc_only"))


_RULES = {"": ["**/*1", "# note", "Never", "/m.*"], "blog.tionble.example.com": ["de/", "!/de/*1"], "tionsh.example.net": ["fr", "*7"]}


@query(f"""WITH u AS (SELECT page_id, {_URL} AS p FROM pages), r(ord, neg, re) AS (VALUES
  (0, false, '^(?:.+/)?[^/]*1(?:/.*)?$'), (1, false, '^m\\.[^/]*(?:/.*)?$'), (2, false, '^blog\\.tionble\\.example\\.com/(?:.+/)?de/.*$'),
  (3, true, '^blog\\.tionble\\.example\\.com/de/[^/]*1(?:/.*)?$'), (4, false, '^tionsh\\.example\\.net(?:/.+)?/fr(?:/.*)?$'), (5, false, '^tionsh\\.example\\.net(?:/.+)?/[^/]*7(?:/.*)?$'))
SELECT page_id, p AS rel_path, coalesce((SELECT NOT arg_max(neg, ord) FROM r WHERE regexp_matches(lower(u.p), re)), false) AS ignored FROM u""")
def ignore_rules(spark, sf_dir):
    rules = ignore.compiled(_RULES)
    return url_paths(spark, sf_dir).select("page_id", "rel_path", ignore.is_ignored(F.col("rel_path"), rules).alias("ignored"))


@query(ORACLE_SQL["ignore_rules"].replace("SELECT page_id, p AS rel_path, coalesce(", "SELECT DISTINCT p AS rel_path FROM u WHERE coalesce(").replace(", false) AS ignored FROM u", ", false)"))
def ignore_rule_table(spark, sf_dir):
    rules = spark.createDataFrame(ignore.compiled(_RULES), "ord int, negated boolean, regex string")
    return ignore.ignored_paths(url_paths(spark, sf_dir), rules)


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedup_first(spark, sf_dir):
    """Of files of one content the first. Only digests are shuffled."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return files.first_by(docs, "digest", "doc_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')")
def changed_semi(spark, sf_dir):
    changed = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP '1998-06-01'").select(F.col("l_orderkey").alias("rel_path"))
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "rel_path")
    return changes.only_changed(orders, changed).select(F.col("rel_path").alias("o_orderkey"), "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def ignored_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


class _Recorded:
    """Changes as a table of nations has them: those of one region by the working tree, of another by the branch."""

    def __init__(self, nation: DataFrame):
        self.nation = nation

    def changed(self) -> set[str]:
        return {r.n_name for r in self.nation.where("n_regionkey = 1").collect()}

    def branch_changed(self, target: str | None = None) -> set[str]:
        return {r.n_name for r in self.nation.where(F.col("n_nationkey") >= int(target or 0)).collect()} | self.changed()


@query("SELECT mode, n_name AS rel_path FROM nation, (VALUES ('all'), ('changes'), ('branch-changes')) AS t(mode) WHERE mode = 'all' OR n_regionkey = 1 OR (mode = 'branch-changes' AND n_nationkey >= 20)")
def change_union(spark, sf_dir):
    """What counts as changed in each mode."""
    nation = table(spark, sf_dir, "nation")
    every = nation.select(F.col("n_name").alias("rel_path"))
    out = []
    for mode in ("all", "changes", "branch-changes"):
        paths = changes.for_mode(_Recorded(nation), mode, "20")
        left = every if paths is None else changes.only_changed(every, changes.relation(spark, paths))
        out.append(left.select(F.lit(mode).alias("mode"), "rel_path"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH t AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END], lambda x: x IS NOT NULL) AS tags FROM labels)
SELECT doc_id, (NOT list_contains(tags, 'toxic') AND list_contains(tags, 'clean')) AS only_clean, (list_contains(tags, 'good') OR list_contains(tags, 'toxic')) AND true AS mixed, true AS unknown_set, false AS unknown_only FROM t""")
def tagset_condition(spark, sf_dir):
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean")))
    ctx = conditions.Context(tagsets={"tone": {"toxic", "clean"}})
    c = lambda text: conditions.column(text, F.col("tags"), ctx)
    return table(spark, sf_dir, "labels").withColumn("tags", tags).select(
        "doc_id", c("TAGONLY:tone:clean").alias("only_clean"), c("(tag:good OR TAGSET:tone:toxic) AND NOT scope:parent").alias("mixed"), c("TAGSET:none:x").alias("unknown_set"), c("TAGONLY:none:x").alias("unknown_only")
    )


_NAMES = "CASE lang WHEN 'en' THEN 'README' WHEN 'fr' THEN doc_id || '.PY' WHEN 'de' THEN 'Dockerfile' ELSE doc_id || '.tar.rs' END"


@query(f"SELECT doc_id, {_NAMES} AS name, CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN 'python' WHEN 'de' THEN 'dockerfile' ELSE 'rust' END AS language, CASE lang WHEN 'fr' THEN 'python' WHEN 'es' THEN 'rust' ELSE 'base' END AS adapter FROM documents")
def language_lookup(spark, sf_dir):
    one = F.col("doc_id").cast("string")
    name = F.when(F.col("lang") == "en", "README").when(F.col("lang") == "fr", F.concat(one, F.lit(".PY"))).when(F.col("lang") == "de", "Dockerfile").otherwise(F.concat(one, F.lit(".tar.rs")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).select("doc_id", "name", lookup.language(F.col("name")).alias("language"), lookup.adapter(F.col("name")).alias("adapter"))


@query(f"""SELECT page_id, CASE WHEN p LIKE 'm.%/en/%' THEN 'all' WHEN regexp_matches(p, '/en/') THEN 'en' WHEN regexp_matches(p, 'ex') THEN 'base' END AS level, CASE WHEN regexp_matches(p, '/en/') AND p LIKE '%1' THEN 'yes' END AS strip
FROM (SELECT page_id, {_URL} AS p FROM pages)""")
def target_override(spark, sf_dir):
    targets = [(["m.*/en/*"], {"level": "all"}), (["*/en/*"], {"level": "en"}), (["*ex*"], {"level": "base"}), (["/*/en/*1"], {"strip": "yes"})]
    o = lookup.target_overrides(F.col("rel_path"), targets)
    return url_paths(spark, sf_dir).select("page_id", o.alias("o")).select("page_id", F.try_element_at("o", F.lit("level")).alias("level"), F.try_element_at("o", F.lit("strip")).alias("strip"))


@query(f"""WITH p AS (SELECT DISTINCT {_URL} AS p FROM pages), s AS (SELECT p, k, len(string_split(p, '/')) = k AS whole, array_to_string(string_split(p, '/')[-k:], '/') AS s FROM (SELECT p, unnest(range(1, len(string_split(p, '/')) + 1)) AS k FROM p)),
n AS (SELECT *, count(*) OVER (PARTITION BY s, k) AS n FROM s)
SELECT p AS rel_path, arg_min(s, k) AS label FROM n WHERE n = 1 OR whole GROUP BY p""")
def label_basename(spark, sf_dir):
    return lookup.unique_suffixes(url_paths(spark, sf_dir).where("rel_path <> ''"))


@query(f"SELECT doc_id, CASE WHEN starts_with(p, 'src1/') THEN substr(p, 6) ELSE p END AS label, CASE WHEN lang = 'en' THEN 'sec:' || source ELSE 'sec@' || lang || ':' || source END AS key FROM (SELECT *, {_PATH} AS p FROM documents)")
def label_scope(spark, sf_dir):
    scope = F.when(F.col("lang") == "en", "self").otherwise(F.col("lang"))
    return corpus(spark, sf_dir).select("doc_id", lookup.relative_label(F.col("rel_path"), "src1/").alias("label"), lookup.resource_key(F.lit("sec"), scope, F.col("source")).alias("key"))


@query(f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents")
def token_count(spark, sf_dir):
    """Each distinct text is counted once, and its count goes back to all its documents by digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cache.counted_once(docs, T.token_count).select("doc_id", "tokens")


@query(f"SELECT doc_id, {_CUT_SQL} AS cut FROM (SELECT *, {_tokens('text')} AS raw FROM documents)")
def token_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_to_tokens(F.col("text"), CUT).alias("cut"))


@query("""WITH s AS (SELECT doc_id, n_chars AS a, doc_id % 4 * n_chars // 3 AS b FROM documents)
SELECT doc_id, greatest(0, a - b) AS saved, greatest(0, a - b) / greatest(b, 1)::DOUBLE AS ratio, greatest(0, a - b) / greatest(b, 1)::DOUBLE >= 2.0 AND (b <> 0 OR greatest(0, a - b) >= 5) AS pays FROM s""")
def token_economy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("a"), F.floor(F.col("doc_id") % 4 * F.col("n_chars") / 3).alias("b"))
    s = T.savings(F.col("a"), F.col("b"))
    return d.select("doc_id", s["saved"].alias("saved"), s["ratio"].alias("ratio"), T.is_economical(F.col("a"), F.col("b"), F.col("b") == 0).alias("pays"))


_SLUG = r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(strip_accents(lower(text)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+', '-', 'g'), '[^a-z0-9\-]+', '', 'g'), '-{2,}', '-', 'g'), '-') AS slug FROM documents"


@query(_SLUG)
def slugify(spark, sf_dir):
    """Anchors of whole texts in all languages: in Spark for ASCII, by Unicode decomposition for the rest."""
    docs = table(spark, sf_dir, "documents").withColumn("ascii", F.col("text").rlike(r"^[\x00-\x7F]*\z"))
    plain = docs.where("ascii").select("doc_id", T.ascii_slug(F.col("text")).alias("slug"))
    return plain.unionByName(docs.where("NOT coalesce(ascii, false)").select("doc_id", markdown.slugs(F.col("text")).alias("slug")))


@query(r"""SELECT doc_id, coalesce(CASE WHEN len(s) >= 2 THEN trim(list_filter(s, lambda x: trim(x) <> '')[1]) END, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), text) AS sentence FROM (SELECT doc_id, text, regexp_split_to_array(text, '[.!?]+') AS s FROM documents)""")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query("""SELECT source, lang, n, '… ' || CASE WHEN n > 1 THEN n || ' ' ELSE '' END || CASE WHEN n = 1 THEN k WHEN k = 'class' THEN 'classes' WHEN k = 'function body' THEN 'function bodies' WHEN k = 'entry' THEN 'entries' ELSE 'comments' END || ' omitted' || CASE WHEN lines > 1 THEN ' (' || lines || ' lines)' ELSE '' END AS placeholder
FROM (SELECT source, lang, count(*) AS n, CASE lang WHEN 'de' THEN 'class' WHEN 'fr' THEN 'function body' WHEN 'es' THEN 'entry' ELSE 'comment' END AS k, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY source, lang)""")
def plural_placeholder(spark, sf_dir):
    kind = F.when(F.col("lang") == "de", "class").when(F.col("lang") == "fr", "function_body").when(F.col("lang") == "es", "entry").otherwise("comment")
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(T.count_pieces(F.col("text"))).alias("lines"))
    return g.select("source", "lang", "n", T.omission(kind, F.lit("omitted"), F.col("n"), F.col("lines")).alias("placeholder"))


@query("SELECT page_id, length(html) - length(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS saved, md5(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS digest FROM pages")
def strip_comments(spark, sf_dir):
    bare = T.strip_html_comments(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", (F.length("html") - F.length(bare)).cast("bigint").alias("saved"), F.md5(bare).alias("digest"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS filled, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS lines, strlen(text)::BIGINT AS bytes FROM documents")
def lines_nonblank(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.count_filled_lines(t).alias("filled"), T.count_lines(t).alias("lines"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("SELECT doc_id, md5(regexp_replace(replace(text, '. ', chr(10) || chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def blank_squeeze(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squeeze_blank_lines(F.replace("text", F.lit(". "), F.lit("\n\n\n")))).alias("digest"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, ' the ', chr(10) || ' ** '), chr(10)), lambda x: trim(regexp_replace(trim(x), '^\*+', ''))), lambda x: x <> ''), chr(10)) AS bare FROM documents""")
def block_comment_clean(spark, sf_dir):
    starred = F.replace(F.col("text"), F.lit(" the "), F.lit("\n ** "))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_block_comment(starred).alias("bare"))


_BODY = "[^A-Za-z0-9 .,]"
_BODIES = f"[^{T.LETTERS}0123456789 .,\n]+"


def outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown outlines: every line is a heading whose level comes from its length, or text; a last line closes each."""
    level = lambda x: (F.length(x) % 5).cast("int")
    line = lambda x, i: F.when(level(x) > 0, F.concat(F.repeat(F.lit("#"), level(x)), F.lit(" h"), i.cast("string"), F.lit(" "), x)).otherwise(x)
    # All lines are cleaned at once, before they are parted.
    lines = F.transform(F.split(F.regexp_replace(F.concat("text", F.lit("\nended")), _BODIES, ""), "\n"), line)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("md"))


_OUTLINE = f"""o AS (SELECT doc_id, line, level, CASE WHEN level IS NOT NULL THEN repeat('#', level) || ' h' || line || ' ' || body ELSE body END AS md, trim('h' || line || ' ' || body, ' ') AS title
FROM (SELECT doc_id, line - 1 AS line, body, CASE WHEN length(body) % 5 > 0 THEN length(body) % 5 END::INT AS level FROM (
  SELECT doc_id, unnest(range(1, len(string_split(text || chr(10) || 'ended', chr(10))) + 1)) AS line, regexp_replace(unnest(string_split(text || chr(10) || 'ended', chr(10))), '{_BODY}', '', 'g') AS body FROM documents)))"""
_LABEL = "<!-- FILE: x.md -->"


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = outlined(spark, sf_dir).select("doc_id", F.explode(markdown.headings(F.col("md"))).alias("h"))
    return h.select("doc_id", F.col("h.start").alias("line"), F.col("h.level").alias("level"), F.col("h.title").alias("title"), F.col("h.end").alias("stop"), F.col("h.path").alias("path"))


def outline_done(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The digest of each outline as the Markdown adapter leaves it."""
    o = markdown.MarkdownOptions(directive_prefix=None, template=None, **options)
    return outlined(spark, sf_dir).select("doc_id", F.md5(markdown.processed(F.col("md"), F.lit("x.md"), o)["text"]).alias("digest"))


@query(f"WITH {_OUTLINE} SELECT doc_id, line::INT AS line, level, title FROM o WHERE level IS NOT NULL")
def heading_parse(spark, sf_dir):
    return headed(spark, sf_dir).select("doc_id", "line", "level", "title")


@query(f"""WITH {_OUTLINE}, s AS (SELECT doc_id, line, CASE WHEN level IS NOT NULL THEN repeat('#', least(6, level + 3 - min(level) OVER (PARTITION BY doc_id))) || substr(md, level + 1) ELSE md END AS md, line = 0 AND level = 1 AS title FROM o)
SELECT doc_id, md5(string_agg(CASE WHEN line > 0 THEN md WHEN title THEN md || chr(10) || '{_LABEL}' ELSE '{_LABEL}' || chr(10) || md END, chr(10) ORDER BY line)) AS digest FROM s GROUP BY doc_id""")
def heading_shift(spark, sf_dir):
    """Headings shifted so that the highest is of level 3, below the file's mark."""
    return outline_done(spark, sf_dir, max_level=3)


_REGION = """n AS (SELECT doc_id, max(line) + 1 AS n FROM o GROUP BY doc_id), g AS (SELECT doc_id, line, level FROM o WHERE level IS NOT NULL),
h AS (SELECT a.doc_id, a.line, a.level, (SELECT min(b.line) FROM g b WHERE b.doc_id = a.doc_id AND b.line > a.line AND b.level <= a.level) AS stop, n FROM g a JOIN n ON n.doc_id = a.doc_id)"""


@query(f"""WITH {_OUTLINE}, {_REGION} SELECT h.doc_id, h.line::INT AS line, h.level, coalesce(h.stop, h.n)::INT AS stop,
(SELECT count(*) FROM h u WHERE u.doc_id = h.doc_id AND u.line < h.line AND coalesce(u.stop, u.n) > h.line AND u.level < h.level)::INT AS depth FROM h""")
def heading_tree(spark, sf_dir):
    """Where each heading's section ends, and how many headings are above it."""
    return headed(spark, sf_dir).select("doc_id", "line", "level", "stop", F.size("path").alias("depth"))


_KEPT = f"""d AS (SELECT doc_id, line, coalesce(stop, n) AS stop FROM h WHERE level = 2),
k AS (SELECT doc_id, line, md, EXISTS (SELECT 1 FROM d WHERE d.doc_id = o.doc_id AND o.line >= d.line AND o.line < d.stop) AS inside FROM o),
j AS (SELECT doc_id, coalesce(string_agg(md, chr(10) ORDER BY line) FILTER (inside = ?), '') AS t, bool_or(inside <> ?) AS cut FROM k GROUP BY doc_id),
q AS (SELECT doc_id, CASE WHEN cut THEN regexp_replace(t, '\n\n\n+', chr(10) || chr(10), 'g') ELSE t END AS t FROM j),
r AS (SELECT doc_id, t, regexp_replace(t, '\n$', '') AS u FROM q)
SELECT doc_id, md5(CASE WHEN t = '' THEN '{_LABEL}' WHEN starts_with(u, '# ') THEN regexp_replace(u, '^([^\n]*)', '\\1' || chr(10) || '{_LABEL}') ELSE '{_LABEL}' || chr(10) || u END) AS digest FROM r"""
_SECOND = markdown.Rule(kind="regex", pattern=".", level=2)


@query(f"WITH {_OUTLINE}, {_REGION}, {_KEPT.replace('?', 'false')}")
def section_drop(spark, sf_dir):
    return outline_done(spark, sf_dir, drop=(_SECOND,))


@query(f"WITH {_OUTLINE}, {_REGION}, {_KEPT.replace('?', 'true')}")
def section_keep(spark, sf_dir):
    return outline_done(spark, sf_dir, keep=(_SECOND,))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an interval of seconds that is as long as its value says."""
    e = table(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_id", start.alias("start"), (start + 3600 * (1 + F.col("event_id") % 7)).alias("end"), "event_type", "value")


_SPANS = "s AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 * (1 + event_id % 7) AS b, event_type FROM events)"
_MERGED = f"""{_SPANS}, i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b, event_id) AS isl FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s)),
g AS (SELECT user_id, min(a) AS a, max(b) AS b, sum(event_id)::BIGINT AS ids, first(event_type ORDER BY b - a DESC, a, b, event_id) AS kind, count(*) AS parts FROM i GROUP BY user_id, isl)"""


@query(f'WITH {_MERGED} SELECT user_id, a AS start, b AS "end", ids AS event_id, kind AS event_type, parts FROM g')
def interval_merge(spark, sf_dir):
    s = spans(spark, sf_dir).withColumn("n", F.col("event_id"))
    out = intervals.merged(s.withColumnRenamed("n", "ord"), ["user_id"], sums=("event_id",), widest=("event_type",), order="ord")
    return out


@query(f"""WITH {_MERGED}, k AS (SELECT user_id, max(b) + 1000 AS n FROM s GROUP BY user_id), x AS (SELECT user_id, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY a), 0) AS a, a AS b FROM g UNION ALL SELECT k.user_id, m, n FROM k JOIN (SELECT user_id, max(b) AS m FROM g GROUP BY user_id) USING (user_id))
SELECT user_id, a AS start, b AS "end" FROM x WHERE a < b""")
def interval_invert(spark, sf_dir):
    s = spans(spark, sf_dir)
    return intervals.inverted(s, s.groupBy("user_id").agg((F.max("end") + 1000).alias("length")), ["user_id"])


@query(f"WITH {_SPANS} SELECT user_id, event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.user_id = s.user_id AND t.a <= s.a AND t.b >= s.b AND (t.a <> s.a OR t.b <> s.b))")
def nested_range_filter(spark, sf_dir):
    return intervals.outermost(spans(spark, sf_dir), ["user_id"]).select("user_id", "event_id")


@query(f"WITH {_SPANS} SELECT user_id, event_id FROM s WHERE EXISTS (SELECT 1 FROM s t WHERE t.user_id = s.user_id AND t.a <= s.a AND t.b >= s.b AND t.event_id <> s.event_id)")
def nested_ranges(spark, sf_dir):
    return intervals.nested(spans(spark, sf_dir), ["user_id"]).select("user_id", "event_id")


_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"""WITH w AS (SELECT *, row_number() OVER p AS rn, sum(l_quantity) OVER p AS run FROM lineitem WINDOW p AS (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)} ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey, bool_and(run <= 60 OR rn <= 1) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)} ROWS UNBOUNDED PRECEDING) AS kept FROM w""")
def budget_prefix(spark, sf_dir):
    return intervals.budget_prefix(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _LINE, "l_quantity", 60, 1).select("l_orderkey", "l_linenumber", "l_partkey", "kept")


@query("SELECT doc_id, CASE WHEN n_chars <= 800 THEN 0 WHEN n_chars // 2 <= 800 THEN 1 WHEN n_chars // 4 <= 800 THEN 2 ELSE 3 END AS step FROM documents")
def budget_ladder(spark, sf_dir):
    costs = [F.floor(F.col("n_chars") / k) for k in (1, 2, 4, 8)]
    return table(spark, sf_dir, "documents").select("doc_id", intervals.ladder_step(costs, 800).alias("step"))


@query("""WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n, sum(value) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM m) GROUP BY user_id, run""")
def run_grouping(spark, sf_dir):
    r = intervals.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return r.groupBy("user_id", "run").agg(F.any_value("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near
FROM (SELECT *, sum(CASE WHEN value > 95 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events)""")
def asof_heading(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").withColumn("seg", F.sum((F.col("value") > 95).cast("int")).over(w))
    near = intervals.as_of(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("event_id")), F.col("seg"))
    return e.select("event_id", near.alias("near"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events")
def adjacency_lag(spark, sf_dir):
    """Seconds since the user's event before: the value as of the row before."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", (at - intervals.as_of(None, ["user_id"], ["ts", "event_id"], at)).alias("gap"))


@query(r"""SELECT conv_id, md5(regexp_replace(string_agg('```' || role || ':' || conv_id || '/' || turn || chr(10) || regexp_replace(text, '\n+$', '') || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY turn), '\s+$', '') || chr(10)) AS digest FROM conversations GROUP BY conv_id""")
def render_fenced(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("rel_path", F.concat_ws("/", "conv_id", "turn"))
    plan = c.select("conv_id", F.col("turn").alias("pos"), "rel_path", F.col("rel_path").alias("label"), F.col("role").alias("language"), F.lit(True).alias("use_fence"))
    return render.rendered(plan, c.select("conv_id", "rel_path", F.col("text").alias("processed_text")), ["conv_id"]).select("conv_id", F.md5("text").alias("digest"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def render_doc(spark, sf_dir):
    return render.joined(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", F.md5("text").alias("digest"))


_EXTENDS = [("app", "base"), ("app", "web"), ("web", "base"), ("api", "base"), ("base", "root")]
_EXTENDING = sorted({x for e in _EXTENDS for x in e})


@query("WITH RECURSIVE e(child, parent) AS (VALUES %s), r(child, extension) AS (SELECT child, child FROM (SELECT child FROM e UNION SELECT parent FROM e) UNION SELECT r.child, e.parent FROM r JOIN e ON r.extension = e.child) SELECT DISTINCT child, '.' || extension AS extension FROM r" % ", ".join(map(str, _EXTENDS)))
def extends_resolution(spark, sf_dir):
    """The extensions that sections have of themselves and of all that they extend."""
    raw = {x: {"extends": [b for a, b in _EXTENDS if a == x], "extensions": [f".{x}"]} for x in _EXTENDING}
    rows = [(x, e) for x in _EXTENDING for e in adaptive.resolve(x, lambda ref, _: (ref, raw[ref])).extensions]
    return spark.createDataFrame(rows, "child string, extension string")


@query("SELECT sha1(string_agg(l, chr(10) ORDER BY l)) AS fingerprint FROM (SELECT 'F ' || sha1(n_name) || ' ' || r_name || '/' || n_nationkey || '.yaml' AS l FROM nation JOIN region ON n_regionkey = r_regionkey)")
def fingerprint(spark, sf_dir):
    """One digest for a configuration tree, which nations are the files of."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = [(f"{r.r_name}/{r.n_nationkey}.yaml", r.n_name.encode()) for r in n.collect()]
    return spark.createDataFrame([(sections.fingerprint(entries),)], "fingerprint string")


_INCLUDES = {"main": ["intro", "body"], "body": ["part", "intro"], "part": ["leaf"], "other": ["leaf"]}


@query("WITH RECURSIVE e(a, b) AS (VALUES %s), r(b) AS (SELECT 'main' UNION SELECT e.b FROM r JOIN e ON r.b = e.a) SELECT 'self' AS scope, 'about-' || b AS section FROM r" % ", ".join(f"('{a}', '{b}')" for a, bs in _INCLUDES.items() for b in bs))
def include_expansion(spark, sf_dir):
    """The sections that a template and all that it includes refer to."""

    def load(kind, name, scope):
        return "\n".join([f"${{about-{name}}}", *[f"${{tpl:{b}}}" for b in _INCLUDES.get(name, [])]]), ""

    found, _ = template.collected("tpl", "main", load)
    return spark.createDataFrame(found, "scope string, section string")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a small Python module: one function a line, private when the line's length is odd."""

    def one(line, i):
        n, at = F.length(line), i.cast("string")
        name = F.concat(F.when(n % 2 == 1, "_").otherwise(""), F.lit("f"), at)
        return F.concat(F.lit("# "), n.cast("string"), F.lit("\ndef "), name, F.lit('(x):\n    """First. Second."""\n    y = x + '), at, F.lit("\n    return y\n"))

    head = F.concat(F.lit("import os\nfrom .near import thing\n\n"), F.array_join(F.transform(F.split("text", "\n"), one), "\n"))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("rel_path"), head.alias("text"), F.lit("python").alias("adapter"), F.lit("x.py").alias("label"))


@query("""SELECT doc_id || '.py' AS rel_path, 'function' AS kind, CASE WHEN length(line) % 2 = 1 THEN '_' ELSE '' END || 'f' || (i - 1) AS name, length(line) % 2 = 0 AS public
FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)""")
def code_elements(spark, sf_dir):
    from loomtext.operators.code import frames

    return frames.elements(sources(spark, sf_dir)).select("rel_path", "kind", "name", "public")


@query("SELECT doc_id || '.py' AS rel_path, m AS module, e AS external FROM documents, (VALUES ('os', true), ('.near', false)) AS t(m, e)")
def code_imports(spark, sf_dir):
    from loomtext.operators.code import frames

    return frames.imports(sources(spark, sf_dir)).select("rel_path", "module", "external")


@query("SELECT doc_id || '.py' AS rel_path, len(string_split(text, chr(10)))::BIGINT AS removed FROM documents")
def code_bodies(spark, sf_dir):
    from loomtext.operators.code import frames

    files = sources(spark, sf_dir).withColumn("options", F.lit('{"strip_function_bodies": true, "placeholders": {"min_savings_ratio": 0}}'))
    out = frames.processed_files(files)
    return out.select("rel_path", F.col("meta")["python.removed.function_body"].cast("bigint").alias("removed"))


@query()
def code_budget(spark, sf_dir):
    """Every module within 200 tokens, or as near as the ladder comes."""
    from loomtext.operators.code import frames

    files = sources(spark, sf_dir).withColumn("options", F.lit('{"budget": {"max_tokens_per_file": 200}}'))
    return frames.processed_files(files).select("rel_path", T.token_count(F.col("text")).alias("before"), T.token_count(F.col("processed_text")).alias("after"))


@query(r"""WITH w AS (SELECT doc_id, string_split_regex(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +') AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, list_transform(w, lambda x: CASE WHEN x = '' THEN 2 ELSE 3 END) AS t FROM w),
k AS (SELECT *, greatest(1, len(list_filter(range(1, least(n, 6) + 1), lambda i: list_sum(t[:i]) <= 12))) AS k FROM c),
d AS (SELECT *, list_sum(t) + n - 1 > 12 AND k < n AND list_sum(t[k + 1:]) + n - k > 4 AS cut FROM k)
SELECT doc_id || '.py' AS rel_path, 'X = [' || array_to_string(list_transform(CASE WHEN cut THEN w[:k] ELSE w END, lambda x: '"' || x || '"'), ', ') || CASE WHEN cut THEN ', "…"' ELSE '' END || ']' || chr(10) AS processed_text FROM d""")
def code_literals(spark, sf_dir):
    """All words of the documents as string lists, trimmed to twelve tokens."""
    from loomtext.operators.code import frames

    words = F.split(F.regexp_replace("text", f"[^{T.LETTERS} ]+", ""), " +")
    text = F.concat(F.lit("X = ["), F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), ", "), F.lit("]\n"))
    files = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".py")).alias("rel_path"), text.alias("text"), F.lit("python").alias("adapter"), F.lit("x").alias("label"), F.lit('{"literals": {"max_tokens": 12}}').alias("options"))
    return frames.processed_files(files).select("rel_path", "processed_text")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' || chr(10) END || text AS text FROM documents")
def md_templating(spark, sf_dir):
    """Directives inside documents."""
    said = F.concat(F.lit("<!-- doc:comment:start -->gone<!-- doc:comment:end --><!-- doc:if tag:"), F.col("lang"), F.lit(" -->yes<!-- doc:else -->no\n<!-- doc:endif -->"), F.col("text"))
    ctx = conditions.bound(conditions.Context({"en"}))

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: markdown.directives(t, ctx)[0], na_action="ignore")

    return table(spark, sf_dir, "documents").select("doc_id", run(said).alias("text"))


@query(_SLUG)
def slugs(spark, sf_dir):
    """Anchors of whole texts in all languages, by Unicode decomposition."""
    return table(spark, sf_dir, "documents").select("doc_id", markdown.slugs(F.col("text")).alias("slug"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM role GROUP BY conv_id")
def conversation_runs(spark, sf_dir):
    """Consecutive turns of a role count once."""
    c = intervals.runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role"])
    one = c.groupBy("conv_id", "run").agg(F.any_value("role").alias("role"))
    return render.joined(one, ["conv_id"], "run", "role", ">", "roles")


def _regions(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return [(r.r_name, r.n_name) for r in n.select("r_name", "n_name").collect()]


@query("SELECT DISTINCT substr(n_name, 1, 1) AS provider, r_name AS context FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'clipboard', r_name FROM region")
def supported_providers(spark, sf_dir):
    """The contexts that support each provider: regions are contexts, and nations modes that run with their first letter."""
    rows = _regions(spark, sf_dir)
    contexts = {r: adaptive.Model.parse({"mode-sets": {"work": {"modes": {n: {"runs": {n[0]: "x"}} for q, n in rows if q == r}}}}) for r, _ in rows}
    letters = sorted({n[0] for _, n in rows} | {adaptive.CLIPBOARD})
    return spark.createDataFrame([(p, c) for p in letters for c in adaptive.supported(contexts.items(), p)], "provider string, context string")


@query("""SELECT n_nationkey::VARCHAR AS set_id, CASE WHEN n_nationkey >= 10 THEN lower(n_name) ELSE n_name END AS set_title, kind || n_regionkey AS tag_id, CASE kind WHEN 'c' THEN lower(n_name) ELSE n_name END AS title, '' AS description
FROM nation, (VALUES ('p'), ('c')) AS t(kind) WHERE (kind = 'p' AND n_nationkey < 15) OR (kind = 'c' AND n_nationkey >= 10)""")
def model_merge(spark, sf_dir):
    """Tag sets of a parent and a child: the child's titles win and the tags of both stay."""
    n = [(r.n_nationkey, r.n_name, r.n_regionkey) for r in table(spark, sf_dir, "nation").collect()]
    parent = {"tag-sets": {str(k): {"title": t, "tags": {f"p{g}": t}} for k, t, g in n if k < 15}}
    child = {"tag-sets": {str(k): {"title": t.lower(), "tags": {f"c{g}": t.lower()}} for k, t, g in n if k >= 10}}
    return adaptive.tag_table(spark, adaptive.Model.parse(parent).merged(adaptive.Model.parse(child)))


@query("SELECT CASE WHEN min(source) = max(source) THEN 'tree/all/' || min(source) ELSE 'tree/all' END AS prefix FROM documents")
def common_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("tree/all"), "source", F.col("doc_id").cast("string")).alias("rel_path"))
    return lookup.common_directory(d)


@query("SELECT event_id, a FROM (SELECT e.event_id, u.a FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS a FROM events) e JOIN (SELECT user_id, min(floor(epoch(ts))::BIGINT) AS a, max(floor(epoch(ts))::BIGINT) AS b FROM events WHERE event_type = 'purchase' GROUP BY user_id) u ON e.user_id = u.user_id AND e.a >= u.a AND e.a < u.b)")
def range_membership(spark, sf_dir):
    """Events between a user's first and last purchase, by a sweep over both."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    r = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("at").alias("start"), F.max("at").alias("end"))
    hit = intervals.in_any(e.select("event_id", "user_id", "at"), r, ["user_id"], "at").where("inside")
    return hit.join(r.select("user_id", F.col("start").alias("a")), "user_id").select("event_id", "a")


more_catalogue.register_outlines(_OUTLINE, _REGION, _KEPT, _LABEL)
for _more in (code_catalogue, more_catalogue):
    QUERIES |= _more.QUERIES
    ORACLE_SQL |= _more.ORACLE_SQL
