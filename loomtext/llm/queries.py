"""The registered queries of this subpackage, with production parameters, over whole tables; SQL where it can say the same."""

from __future__ import annotations

import gzip
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.arc import convert
from loomtext.llm.arrow_text import mapped
from loomtext.llm.exact_dedup import exact_dedup
from loomtext.llm.fingerprints import fingerprints
from loomtext.llm.minhash import near_duplicates
from loomtext.llm.mixing import copies, rated
from loomtext.llm.packing import packed
from loomtext.llm.quality import good_documents
from loomtext.llm.token_counts import token_counts
from loomtext.llm.toxicity import toxic_documents
from loomtext.llm.url_filter import judged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


_ABOUT = {
    1: "1 0 pages\nURL IP-address Archive-date Content-type Archive-length\n\n",
    2: "2 0 pages\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n",
}
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Pages in an archive, by their ids.
PER_FILE = 16


def archived(pages: DataFrame) -> DataFrame:
    """All pages in ARC files ``(path, content)`` of :data:`PER_FILE`: versions 1 and 2 in turn, and half of each gzipped by record."""
    file = F.floor(F.col("page_id") / PER_FILE).cast("bigint")
    even = file % 2 == 0
    path = F.concat(F.lit("pages-"), file.cast("string"), F.lit(".arc"))
    date = F.concat(F.lit("200102"), F.lpad((F.pmod(file, F.lit(28)) + 1).cast("string"), 2, "0"), F.lit("120000"))
    about = F.when(even, F.lit(_ABOUT[1])).otherwise(F.lit(_ABOUT[2]))
    block = F.concat(F.lit(_HTTP), F.col("html"))
    size = lambda x: F.octet_length(x).cast("string")
    more = lambda result, check: F.when(even, F.lit(" ")).otherwise(F.concat(F.lit(f" {result} "), check, F.lit(" - 0 "), path, F.lit(" ")))
    head = F.concat(F.lit("filedesc://"), path, F.lit(" 0.0.0.0 "), date, F.lit(" text/plain"), more(200, F.lit("-")), size(about), F.lit("\n"), about, F.lit("\n"))
    page = F.concat(F.col("url"), F.lit(" 192.0.2.1 "), date, F.lit(" text/html"), more(200, F.md5("html")), size(block), F.lit("\n"), block, F.lit("\n"))
    each = pages.select(file.alias("file"), path.alias("path"), head.alias("head"), F.struct("page_id", F.encode(page, "UTF-8").alias("page")).alias("page"))
    files = each.groupBy("file", "path").agg(F.encode(F.any_value("head"), "UTF-8").alias("head"), F.array_sort(F.collect_list("page")).alias("pages"))

    def joined(batches):
        for batch in batches:
            out = []
            for file_, head_, pages_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                members = [head_, *[p["page"] for p in pages_]]
                out.append(b"".join(gzip.compress(m, 1, mtime=0) for m in members) if file_ // 2 % 2 else b"".join(members))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(out, pa.binary())], names=["path", "content"])

    return mapped(files.select("file", "head", "pages", "path"), joined, "path string, content binary")


@query
def op1_arc_to_warc(spark, sf_dir):
    """The WARC records of all pages, with their blocks."""
    return convert(archived(_table(spark, sf_dir, "pages")))


def _chr(text: str) -> str:
    return "('" + text.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "')"


def _base32(text: str) -> str:
    bits = f"((('0x' || substr(sha1({text}), CAST(5 * (i // 4) + 1 AS INTEGER), 5))::INTEGER >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)"
    return f"'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {bits}, 1)), '')"


ORACLE_SQL["op1_arc_to_warc"] = f"""
WITH p AS (
  SELECT page_id, url, html, page_id // {PER_FILE} AS file, page_id // {PER_FILE} % 2 = 0 AS even, 'pages-' || page_id // {PER_FILE} || '.arc' AS path,
         '200102' || lpad(CAST(page_id // {PER_FILE} % 28 + 1 AS VARCHAR), 2, '0') || '120000' AS date,
         {_chr(_HTTP)} || html AS page
  FROM pages
), q AS (
  SELECT *, strlen(url || ' 192.0.2.1 ' || date || ' text/html' || CASE WHEN even THEN ' ' ELSE ' 200 ' || md5(html) || ' - 0 ' || path || ' ' END || strlen(page)) + 1 + strlen(page) + 1 AS taken,
         CASE WHEN even THEN {_chr(_ABOUT[1])} ELSE {_chr(_ABOUT[2])} END AS about
  FROM p
), f AS (
  SELECT DISTINCT file, path, even, date, about, strlen('filedesc://' || path || ' 0.0.0.0 ' || date || ' text/plain' || CASE WHEN even THEN ' ' ELSE ' 200 - - 0 ' || path || ' ' END || strlen(about)) + 1 + strlen(about) + 1 AS opening FROM q
), r AS (
  SELECT path, 0::BIGINT AS "offset", even, 'warcinfo' AS warc_type, 'filedesc://' || path AS name, date, NULL AS target_uri, NULL AS ip_address, 'text/plain' AS content_type, about AS block, NULL AS html, NULL AS http_status FROM f
  UNION ALL
  SELECT q.path, (f.opening + sum(taken) OVER (PARTITION BY file ORDER BY page_id) - taken)::BIGINT, q.even, 'response', url, q.date, url, '192.0.2.1', 'application/http; msgtype=response', page, html, 200 FROM q JOIN f USING (file)
), s AS (
  SELECT *, sha1(path || chr(10) || "offset" || chr(10) || name || chr(10) || date) AS h FROM r
)
SELECT path, "offset", CASE WHEN even THEN 1 ELSE 2 END::INTEGER AS arc_version, warc_type,
       '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' AS warc_record_id,
       substr(date, 1, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) || 'T12:00:00Z' AS warc_date,
       CAST(target_uri AS VARCHAR) AS target_uri, CAST(ip_address AS VARCHAR) AS ip_address, content_type, strlen(block)::BIGINT AS content_length,
       {_base32("block")} AS block_digest, CASE WHEN html IS NOT NULL THEN {_base32("html")} END AS payload_digest,
       http_status::INTEGER AS http_status, NULL::VARCHAR AS problem, encode(block) AS block
FROM s
"""

#: What crawls of these sites may keep.
ENTRIES = [
    ("example.net", "block"), ("tionsh.example.net", "allow"), ("tionsh.example.net/de", "block"), ("example.net/en", "allow"), ("example.com/fr", "block"), ("tionble.example.com/fr", "allow"),
    ("blog.tionble.example.com", "block"), ("m.thernd.example.com", "block"), ("m.thernd.example.com/en", "allow"), ("thering.example.org", "block"), ("www.thering.example.org", "allow"), ("example.org/es", "block"),
]


#: Besides those, a list of the size that crawls use: hosts, and single pages of a site.
LISTED = 120_000
_LISTED = f"""SELECT CASE WHEN i % 4 = 0 THEN 'example.com/' || CASE WHEN i % 8 = 0 THEN 'en' ELSE 'fr' END || '/' || CAST(i / 4 AS BIGINT) ELSE 's' || i || '.example.net' END AS entry,
CASE WHEN i % 3 = 0 THEN 'allow' ELSE 'block' END AS action FROM (SELECT * FROM {{}}) WHERE i >= 0"""


@query
def op3_url_filter(spark, sf_dir):
    """Every page's action and the entry that decided it."""
    entries = spark.createDataFrame(ENTRIES, "entry string, action string").unionByName(spark.sql(_LISTED.format(f"range({LISTED}) AS t(i)")))
    return judged(_table(spark, sf_dir, "pages").select("page_id", "url"), entries)


ORACLE_SQL["op3_url_filter"] = r"""
WITH l AS (SELECT * FROM (VALUES %s) AS t(entry, action) UNION ALL %s),
e AS (SELECT entry, action, regexp_extract(entry, '^[^/]*') AS host, regexp_extract(entry, '/.*$') AS path FROM l),
u AS (
  SELECT page_id, url,
         list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), lambda x: x <> '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS path
  FROM pages
), h AS (
  SELECT page_id, path, k AS labels, array_to_string(host[-k:], '.') AS h FROM (SELECT *, unnest(range(1, len(host) + 1)) AS k FROM u)
), p AS (
  SELECT page_id, labels, h, k AS segments, CASE WHEN k = 0 THEN '' ELSE '/' || array_to_string(path[:k], '/') END AS p FROM (SELECT *, unnest(range(0, len(path) + 1)) AS k FROM h)
), m AS (
  SELECT page_id, entry, action, row_number() OVER (PARTITION BY page_id ORDER BY labels DESC, segments DESC, action = 'block' DESC) AS nth FROM p JOIN e ON e.host = p.h AND e.path = p.p
)
SELECT u.page_id, u.url, coalesce(m.action, 'allow') AS action, m.entry FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.nth = 1
""" % (", ".join(f"('{e}', '{a}')" for e, a in ENTRIES), _LISTED.format(f"range({LISTED}) AS t(i)"))


@query
def op4_fingerprints(spark, sf_dir):
    """Every document's root name and signatures."""
    return fingerprints(_table(spark, sf_dir, "documents"))


#: Shares of the tokens that each language is to have.
TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The table the domain classifier learns from: the documents that were labelled by hand, with their language as the domain."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


@query
def op2_packing(spark, sf_dir):
    """Where every piece of every document is packed, in tokens of the vocabulary."""
    return packed(token_counts(_table(spark, sf_dir, "documents")), length=F.col("n_tokens"))


@query
def op5_mixing(spark, sf_dir):
    """Every document's rate, and how often it is taken."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = rated(docs, labelled_domains(docs, _table(spark, sf_dir, "labels")), TARGETS, columns=["doc_id"])
    return out.select("doc_id", "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


@query
def op6_minhash(spark, sf_dir):
    """Every near duplicate with the document kept for it."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op7_exact_dedup(spark, sf_dir):
    """The documents that stay."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


@query
def op8_quality(spark, sf_dir):
    """The documents that the classifier keeps, and their scores."""
    kept = good_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "quality_score")


@query
def op9_token_counts(spark, sf_dir):
    """Tokens of every document."""
    return token_counts(_table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark, sf_dir):
    """The toxic documents, with their significant passages."""
    return toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLE_SQL["op7_exact_dedup"] = r"""
SELECT doc_id, text, lang, source, n_chars
FROM (
  SELECT *, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^[ \t\n\f]+|[ \t\n\f]+$', '', 'g') ORDER BY doc_id) AS nth
  FROM documents
)
WHERE nth = 1
"""
