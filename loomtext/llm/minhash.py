"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations of ``range(UNIVERSE)`` make every signature coordinate: the first scatters a document's shingles, the
second, shifted circularly by k, gives coordinate k. A shingle's values for all coordinates are then neighbours in
memory, and a signature is the minimum of such windows.

Documents that agree on a band are candidates. Every candidate pair whose outcome can change the groups is verified on
the full shingle sets: first each bucket's members against its smallest id, and then, where a bucket still spans more
than one group, members against ever more leaders of the bucket, joining groups in between. Pairs inside one group would
change nothing, so copies in thousands cost a star of comparisons and not a square, and no pair, bucket or partner is
capped. As groups only grow, a bucket that lies in one group is done with: the rounds go on with the members of the other
buckets, and with those members' shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import arrow_text
from loomtext.llm.components import connected
from loomtext.llm.storage import discard, fresh, written

SHINGLE_WORDS = 3
THRESHOLD = 0.55
BANDS, ROWS = 32, 4
UNIVERSE = 1 << 20
SEED = 20240229
#: Lists of ids, pairs and buckets of up to so many bytes are broadcast; longer ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: In an open bucket a task compares about so many pairs.
SALT_PAIRS = 1 << 20

def shingle_sets(column, width: int):
    """For slices of a text column: the first row, the distinct shingles' 64-bit hashes in (row, hash) order, and the rows' bounds among them.

    A text of fewer words than ``width`` has one shingle, of all its words; one without words has none. A word is a run
    of bytes without ASCII white space, so that text in a script without blanks is compared by its longer runs.
    """
    texts = arrow_text.strings(column)
    for lo, hi in arrow_text.slices(texts):
        part = texts[lo:hi]
        hashes, bounds = arrow_text.words(*arrow_text.raw(part))
        counts = np.diff(bounds)
        with np.errstate(over="ignore"):
            mixed = np.zeros(len(hashes), np.uint64)
            for k in range(min(width, len(hashes))):
                mixed[: len(hashes) - k] += arrow_text.mix64(hashes[k:] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
            whole = np.repeat(bounds[1:], counts) - np.arange(len(hashes)) >= width
            short = np.flatnonzero((counts > 0) & (counts < width))
            for r in short:
                w = hashes[bounds[r] : bounds[r + 1]]
                mixed[bounds[r]] = np.bitwise_xor.reduce(arrow_text.mix64(w + np.arange(1, len(w) + 1, dtype=np.uint64))) + np.uint64(len(w))
            whole[bounds[short]] = True
            keys = arrow_text.mix64(mixed[whole])
        ends = np.append(0, whole.cumsum())[bounds]
        for r in range(len(part)):
            keys[ends[r] : ends[r + 1]].sort()
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        new[ends[:-1][ends[:-1] < ends[1:]]] = True
        yield lo, keys[new], np.append(0, new.cumsum())[ends]


def permutations(universe: int, coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and a view whose row x is the second permutation's circular window of all shifts from x."""
    rng = np.random.default_rng(seed)
    scatter = rng.permutation(universe).astype(np.uint32)
    ring = rng.permutation(universe).astype(np.uint32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, scatter: np.ndarray, windows: np.ndarray) -> np.ndarray:
    at = scatter[shingles & np.uint64(len(scatter) - 1)]
    out = windows[at[:1024]].min(axis=0)
    for i in range(1024, len(at), 1024):
        np.minimum(out, windows[at[i : i + 1024]].min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width=SHINGLE_WORDS, bands=BANDS, rows=ROWS, universe=UNIVERSE, seed=SEED) -> DataFrame:
    """``id``, number of distinct shingles ``n``, 128 bits ``hi, lo`` of the shingle set, and its band hashes; texts without words and null ids give no row."""
    taken = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = taken.schema["id"].dataType

    def run(batches):
        scatter, windows = permutations(universe, bands * rows, seed)
        salt = arrow_text.mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            ids = batch.column(0)
            for first, sets, bounds in shingle_sets(batch.column(1), width):
                some = np.flatnonzero(np.diff(bounds))
                if len(some) == 0:
                    continue
                sig = np.stack([signature(sets[bounds[r] : bounds[r + 1]], scatter, windows) for r in some]).astype(np.uint64)
                with np.errstate(over="ignore"):
                    keys = np.broadcast_to(salt, (len(some), bands)).copy()
                    for k in range(rows):
                        keys = arrow_text.mix64(keys * np.uint64(0x100000001B3) + sig.reshape(len(some), bands, rows)[:, :, k])
                    hi = np.add.reduceat(arrow_text.mix64(sets + np.uint64(1)), bounds[some])
                    lo = np.add.reduceat(arrow_text.mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), bounds[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(some + first)), pa.array(np.diff(bounds)[some].astype(np.int32)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "hi", "lo", "bands"],
                )

    return arrow_text.mapped(taken, run, f"id {kind.simpleString()}, n int, hi bigint, lo bigint, bands array<bigint>")


def sets_of(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, width=SHINGLE_WORDS) -> DataFrame:
    """``id`` and sorted distinct shingles ``s`` of the rows whose id is in ``ids``."""
    taken = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = taken.schema["id"].dataType
    wanted = taken.join(sent(ids), "id", "left_semi")

    def run(batches):
        for batch in batches:
            for first, sets, bounds in shingle_sets(batch.column(1), width):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), lists], names=["id", "s"])

    return arrow_text.mapped(wanted, run, f"id {kind.simpleString()}, s array<bigint>")


def small(table: DataFrame) -> bool:
    """Whether a table of ids and the like may be broadcast, by its bytes."""
    bytes_ = sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 32 for c in table.columns)
    return (table.agg(F.sum(bytes_)).first()[0] or 0) <= BROADCAST_BYTES


def sent(table: DataFrame) -> DataFrame:
    """The table with the hint by which it is joined: a broadcast if it is small, else a merge of shuffled rows."""
    return F.broadcast(table) if small(table) else table.hint("merge")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have Jaccard similarity of at least ``threshold``.

    Pairs that may be broadcast are taken to the sets: then a set is shuffled once as ``a`` and once for each pair as ``b``,
    and sets in no pair are not.
    """
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    if small(pairs):
        pairs, left = F.broadcast(pairs), left.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def split_buckets(members: DataFrame, group: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bucket, id, root)`` of the members whose buckets lie in several groups, and those buckets with their sizes. Both are written tables.

    Sizes and bounds are aggregated before they meet the members, so that a bucket of a third of all rows is a row here.
    """
    labelled = members.select("bucket", "id").join(group.withColumnRenamed("node", "id"), "id", "left")
    labelled = written(labelled.select("bucket", "id", F.coalesce("root", "id").alias("root")), "labelled")
    bounds = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    sizes = written(bounds.where("r0 != r1").select("bucket", "size"), "open-buckets")
    open_ = written(labelled.join(sent(sizes.select("bucket")), "bucket", "left_semi"), "open-members")
    discard(labelled)
    return open_, sizes


def joined_groups(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The groups ``(node, root)`` after more edges between nodes, of which those in no group are alone. Only the groups' roots are connected anew."""
    if edges.isEmpty():
        return found
    root = found.select(F.col("node").alias("n"), F.col("root").alias("r"))
    ends = edges.join(root, F.col("a") == F.col("n"), "left").select("b", F.coalesce("r", "a").alias("a"))
    ends = ends.join(root, F.col("b") == F.col("n"), "left").select("a", F.coalesce("r", "b").alias("b"))
    moved = connected(ends)
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    kept = found.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = written(kept.unionByName(moved.join(found.select("node"), "node", "left_anti")), "components")
    discard(moved)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, universe: int = UNIVERSE, seed: int = SEED, shortcut: bool = True
) -> DataFrame:
    """``(id_col, keep_<id_col>)`` for every document that has a near duplicate of smaller id: itself, and the smallest id of its group.

    Groups are the connected components of the candidate pairs whose word-shingle sets are at least ``threshold``
    similar. At the threshold the bands find a pair with probability ``1 - (1 - threshold**rows)**bands`` (0.95 with the
    defaults), and more often above it. ``universe`` is a power of two. With ``shortcut`` of equal sets only one takes part
    in the bands; that they are equal is verified like every link.

    A null, empty or blank text is nobody's duplicate, and neither is a row with a null id. Rows that repeat an id are
    one document of several texts, near whatever any of them is near. Texts of fewer than ``width`` words are near duplicates only of texts
    with the same words. A very long text is shingled whole, as one task's work. Other columns are not read. An empty
    table gives an empty one.
    """
    sig = written(signatures(docs, id_col, text_col, width, bands, rows, universe, seed), "signatures")
    # Of sets that seem equal one goes on into the bands; the others need but be compared with it.
    alike = written(sig.groupBy("hi", "lo", "n").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("k")).where(F.col("k") > (1 if shortcut else F.lit(None))).drop("k"), "alike")
    same = written(sig.select("id", "hi", "lo", "n").join(alike, ["hi", "lo", "n"]).where("id != a").select("a", F.col("id").alias("b"), "hi", "lo", "n").distinct(), "same")
    # Only the text that equals another goes: an id's other texts keep their bands.
    reps = written(sig.join(sent(same.select(F.col("b").alias("id"), "hi", "lo", "n")), ["id", "hi", "lo", "n"], "left_anti").select("id", "bands"), "representatives")
    discard(sig)
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    leads = written(banded.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead != last").select("bucket", "lead"), "leads")
    members = written(banded.join(sent(leads), "bucket").distinct(), "buckets")
    star = written(members.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).union(same.select("a", "b")).distinct(), "star")
    ids = written(star.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates")
    sets = written(sets_of(docs, id_col, text_col, ids, width), "sets")
    edges = written(verified(star, sets, threshold), "edges")
    apart = shortcut and not same.select("a", "b").join(edges, ["a", "b"], "left_anti").isEmpty()
    for used in (reps, alike, same, leads, ids):
        discard(used)
    if apart:  # sums of 128 bits agree, but the sets don't: no set may stand for another
        for used in (members, star, sets, edges):
            discard(used)
        return near_duplicates(docs, id_col, text_col, threshold, width, bands, rows, universe, seed, shortcut=False)
    found = connected(edges)
    discard(edges)
    # What the stars left open. Leaders of a bucket are those of its members whose hashes are lowest, each time eight times
    # as many as before and at last all; those of the last round have met everyone.
    met = star
    leaders = 2
    while True:
        before, (open_, sizes) = members, split_buckets(members, found)
        members = open_
        discard(before)
        hottest = sizes.agg(F.max("size")).first()[0]
        if hottest is None or leaders >= hottest:
            discard(sizes)
            break
        leaders *= 8
        before, sets = sets, written(sets.join(sent(open_.select("id").distinct()), "id", "left_semi"), "sets")
        discard(before)
        draw = F.pmod(F.xxhash64("bucket", "id"), F.lit(1 << 52)) / float(1 << 52)
        # With so many leaders a member is spread over as many keys, and the leaders are copied to each.
        salts = F.greatest(F.lit(1), F.least(F.lit(4096), F.ceil(F.col("size") * F.least(F.lit(leaders), F.col("size")) / SALT_PAIRS))).cast("int")
        now = open_.join(sizes, "bucket").withColumn("salts", salts)
        x = now.where(draw * F.col("size") < leaders).select("bucket", F.col("id").alias("x"), F.col("root").alias("rx"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        y = now.select("bucket", F.col("id").alias("y"), F.col("root").alias("ry"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
        pairs = x.join(y, ["bucket", "salt"]).where("rx != ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        across = written(pairs.join(met, ["a", "b"], "left_anti"), "across")
        before, met = met, written(met.unionByName(across), "met")
        discard(before)
        edges = written(verified(across, sets, threshold), "edges")
        before, found = found, joined_groups(found, edges)
        for used in (sizes, across, edges, *([before] if found is not before else [])):
            discard(used)
    for used in (met, members, sets):
        discard(used)
    return found.where("node != root").select(F.col("node").alias(id_col), F.col("root").alias(f"keep_{id_col}"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` finds a smaller id for; one of each group stays, with all its columns.

    Rows that share an id go or stay together. A null id or text, an empty and a blank text stay.
    """
    (key,) = fresh(docs.columns, "gone")
    gone = written(near_duplicates(docs, id_col, text_col, **how).select(F.col(id_col).alias(key)), "gone")
    return docs.join(F.broadcast(gone) if small(gone) else gone, docs[id_col] == gone[key], "left_anti")
