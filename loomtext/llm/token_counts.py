"""Exact token counts of whole texts, huge ones encoded in overlapping chunks that are spliced where both sides agree.

A byte-pair encoding never merges across the boundaries of its pre-tokenizer, and the pre-tokenizer reads left to right
without looking back. So where a scan that is right up to p, and a scan that began anywhere, both start a pre-token at
p, they agree on everything after p: p is a proven boundary. Chunks overlap; each reports its boundaries, with the
tokens before them, near its two ends; neighbours are spliced at their first common one. A text of which two
neighbours have none in common (a run without boundaries longer than the overlap) is done again with wider overlaps,
at last as one chunk.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import arrow_text
from loomtext.llm.storage import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk without its overlap, and of the first overlap; each round of widening multiplies both.
CHUNK, OVERLAP, WIDEN = 32_768, 256, 8
#: A pre-token that ends so close to a chunk's end might have gone on; its end is no boundary.
MARGIN = 4

_ENCODINGS: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(ranks: bytes, pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and each token's length in bytes; made once in a worker."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            lengths[rank] = len(token)
        _ENCODINGS[key] = tiktoken.Encoding(key[:8], pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths
    return _ENCODINGS[key]


def boundaries(piece: str, encoder: tiktoken.Encoding, lengths: np.ndarray, scan) -> tuple[np.ndarray, np.ndarray, int]:
    """Character offsets at which pre-tokens start or the piece ends, how many tokens lie before each, and how many there are."""
    ends = np.append(0, lengths[np.array(encoder.encode_ordinary(piece), np.int64)].cumsum())
    chars = np.array([m.start() for m in scan.finditer(piece)] + [len(piece)], np.int64)
    points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.append(0, width.cumsum())[chars]
    before = np.searchsorted(ends, at)
    assert (ends[before] == at).all(), "a token crosses a pre-token's boundary"
    return chars, before, len(ends) - 1


def _chunked(texts: DataFrame, shared, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``id, h, size, n`` of each row of ``(id, h, size, text)``; ``n`` is null where two neighbouring chunks have no common boundary."""
    kind = texts.schema["id"].dataType.simpleString()
    # Rows of one id and text have one number, whichever task reads them: they are encoded each and counted together.
    rows = texts.withColumn("r", F.xxhash64("id", "h", "size"))

    def split(batches):
        for batch in batches:
            ids, h, size, text, r = batch.columns
            for i in range(batch.num_rows):
                whole = text[i].as_py()
                starts = range(0, max(1, len(whole) - overlap), chunk)
                for a in range(0, len(starts), 64):
                    some = starts[a : a + 64]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(ids[i], m), pa.repeat(h[i], m), pa.repeat(size[i], m), pa.repeat(r[i], m), pa.array(some, pa.int64()), pa.array([whole[s : s + chunk + overlap] for s in some], pa.string())],
                        names=["id", "h", "size", "r", "start", "piece"],
                    )

    def encode(batches):
        encoder, lengths = encoding(shared.value, pattern)
        scan = regex.compile(pattern)
        for batch in batches:
            out = []
            for start, size, piece in zip(batch.column("start").to_pylist(), batch.column("size").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                at, before, n = boundaries(piece, encoder, lengths, scan)
                last = start + len(piece) >= size
                head = at < min(overlap, len(piece))
                tail = (at >= chunk) & (at <= len(piece) - MARGIN) if not last else np.zeros(len(at), bool)
                out.append(((at[head] + start).tolist(), before[head].tolist(), (at[tail] + start).tolist(), before[tail].tolist(), n))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "h", "size", "r", "start")], *[pa.array([o[k] for o in out], longs) for k in range(4)], pa.array([o[4] for o in out], pa.int64())],
                names=["id", "h", "size", "r", "start", "hp", "hn", "tp", "tn", "n"],
            )

    pieces = arrow_text.mapped(rows.select("id", "h", "size", "text", "r"), split, f"id {kind}, h bigint, size bigint, r bigint, start bigint, piece string")
    coded = arrow_text.mapped(pieces.repartition("r", "start"), encode, f"id {kind}, h bigint, size bigint, r bigint, start bigint, hp array<bigint>, hn array<bigint>, tp array<bigint>, tn array<bigint>, n bigint")
    same = ["id", "h", "size", "r", "start"]
    coded = coded.groupBy(*same).agg(*[F.any_value(c).alias(c) for c in ("hp", "hn", "tp", "tn", "n")], F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("r").orderBy("start")
    met = coded.select("*", F.lead("hp").over(order).alias("np"), F.lead("hn").over(order).alias("nn"))
    p = F.try_element_at(F.array_intersect("tp", "np"), F.lit(1))
    met = met.withColumn("p", p)
    here = F.try_element_at("tn", F.array_position("tp", F.col("p")).cast("int"))
    there = F.try_element_at("nn", F.array_position("np", F.col("p")).cast("int"))
    # What a chunk adds: its tokens, or those before the splice, less those that the next chunk has before it.
    adds = F.when(F.col("np").isNull(), F.col("n")).otherwise(here - there)
    fails = F.col("np").isNotNull() & F.col("p").isNull()
    done = met.groupBy("r").agg(F.first("id").alias("id"), F.first("h").alias("h"), F.first("size").alias("size"), F.when(~F.bool_or(fails), F.sum(F.when(~fails, adds))).alias("n"), F.any_value("times").alias("times"))
    return done.select("id", "h", "size", "n", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).drop("nth")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(id_col, n_tokens)`` for every row of ``docs``: as many tokens as encoding the whole text at once gives.

    ``vocabulary`` is a file of byte-level ranks; the driver reads and broadcasts it (about a megabyte). Texts longer
    than ``chunk`` characters are spread over the cluster in chunks. A null or empty text has 0 tokens. A null id is
    kept. Repeated rows are returned each, and texts of one id told apart by a hash of 64 bits and their length. Special tokens have no special meaning in a text. Other columns
    are not read. An empty table gives an empty one.
    """
    if overlap <= MARGIN or chunk <= overlap:
        raise ValueError("chunk must exceed overlap, and overlap the margin")
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def short(batches):
        encoder, _ = encoding(shared.value, pattern)
        for batch in batches:
            column = arrow_text.strings(batch.column(1))
            counts = np.zeros(len(column), np.int64)
            for lo, hi in arrow_text.slices(column):
                counts[lo:hi] = [len(encoder.encode_ordinary(t)) for t in column[lo:hi].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], names=["id", "n"])

    result = arrow_text.mapped(texts.where(F.length("text") <= chunk), short, f"id {kind}, n bigint")
    long = texts.where(F.length("text") > chunk).select("id", F.xxhash64("text").alias("h"), F.length("text").cast("bigint").alias("size"), "text")
    todo = long
    while True:
        found = written(_chunked(todo, shared, pattern, chunk, overlap), "token-counts")
        result = result.unionByName(found.where("n IS NOT NULL").select("id", "n"))
        left = found.where("n IS NULL").select("id", "h", "size").distinct()
        if left.isEmpty():
            return result.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"))
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
        again = left.select(F.col("id").alias("i"), F.col("h").alias("g"), F.col("size").alias("z"))
        todo = long.join(again, long["id"].eqNullSafe(again["i"]) & (long["h"] == again["g"]) & (long["size"] == again["z"]), "left_semi")
