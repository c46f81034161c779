"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases' names again, and so on up to one name for the whole. Where phrases begin is
decided by deterministic coin tossing, which looks at a few neighbouring symbols only; so inside equal substrings,
apart from a margin at both ends, phrases and their names are equal, at whatever offset the substrings lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import arrow_text

#: The level whose names are the signatures: phrases of about 20 bytes, so that a passage of 50 words has several inside.
LEVEL = 3
_STEP = np.uint64(0x9FB21C651E98DF25)


def _collapse(symbols, new):
    """Runs of one symbol become one symbol; ``new`` marks the first symbol of each text. Returns the symbols and their places."""
    start = new.copy()
    start[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(symbols)))
    out = symbols[at]
    runs = length > 1
    with np.errstate(over="ignore"):
        out[runs] = arrow_text.mix64(out[runs] * _STEP + length[runs].astype(np.uint64))
    return out, at


def _toss(x, first):
    """One round: each symbol's lowest bit that differs from the symbol before, and that bit's value. Neighbours stay different."""
    differ = np.empty_like(x)
    differ[1:] = x[1:] ^ x[:-1]
    differ[first] = 1
    low = differ & (~differ + x.dtype.type(1))
    place = np.bitwise_count(low - x.dtype.type(1))
    return (place << np.uint8(1)) | ((x & low) != 0).astype(np.uint8)


def coin_toss(symbols, first):
    """Colours 0, 1, 2 of which no two neighbours in a text are equal; ``first`` are the places where texts begin."""
    colour = _toss(symbols, first)
    for _ in range(3):
        colour = _toss(colour, first)
    before, after = np.empty_like(colour), np.empty_like(colour)
    last = np.append(first[1:], len(colour)) - 1
    for high in (3, 4, 5):
        at = np.flatnonzero(colour == high)
        before[1:], after[:-1] = colour[:-1], colour[1:]
        before[first], after[last] = 255, 255
        b, a = before[at], after[at]
        pick = np.full(len(at), 2, np.uint8)
        pick[(b != 1) & (a != 1)] = 1
        pick[(b != 0) & (a != 0)] = 0
        colour[at] = pick
    return colour


def parse(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the phrases' names, and the texts' bounds among them. A text of one symbol stays as it is."""
    n = np.diff(bounds)
    new = np.zeros(len(symbols), bool)
    new[bounds[:-1][n > 0]] = True
    flat, at = _collapse(symbols, new)
    first = np.flatnonzero(new[at])
    colour = coin_toss(flat, first)
    # A phrase begins at each local maximum and at each text's beginning.
    begin = np.zeros(len(flat), bool)
    begin[1:-1] = (colour[1:-1] > colour[:-2]) & (colour[1:-1] > colour[2:])
    last = np.append(first[1:], len(flat)) - 1
    begin[last] = False
    begin[first[first + 1 < len(flat)] + 1] = False
    begin[first] = True
    starts = np.flatnonzero(begin)
    length = np.diff(np.append(starts, len(flat)))
    place = np.arange(len(flat)) - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        names = arrow_text.mix64(np.add.reduceat(arrow_text.mix64(flat + place.astype(np.uint64) * _STEP), starts) + length.astype(np.uint64))
    alone = np.repeat(n, n)[at[starts]] == 1
    names[alone] = flat[starts[alone]]
    return names, np.searchsorted(at[starts], bounds)


def fingerprint_slice(body: np.ndarray, bounds: np.ndarray, level: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each text: the sorted distinct names of ``level`` (of its last level, if that comes before), its root name, and its height."""
    symbols, at = body.astype(np.uint64) + np.uint64(1), bounds
    texts = len(bounds) - 1
    height = np.zeros(texts, np.int32)
    names: list[np.ndarray] = [np.zeros(0, np.uint64)] * texts
    depth = 0
    while len(symbols):
        if depth == level:
            names = [np.unique(symbols[at[i] : at[i + 1]]) for i in range(texts)]
        size = np.diff(at)
        if size.max() <= 1:
            break
        height += size > 1
        symbols, at = parse(symbols, at)
        depth += 1
    root = np.zeros(texts, np.uint64)
    some = np.diff(at) > 0
    root[some] = symbols[at[:-1][some]]
    if depth < level:
        names = [root[i : i + 1] if some[i] else names[i] for i in range(texts)]
    return names, root, height


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL) -> DataFrame:
    """``id_col, root, height, signatures`` for every row: one name for the whole text, the levels above its bytes, and the distinct names of ``level``.

    Texts with equal bytes have equal roots. A text too short for ``level`` has its root as its signature. A null or
    empty text has a null root, height 0 and no signatures. Null ids are kept and repeated rows returned each; of equal
    names in a text one is returned. A very long text is parsed whole, as one task's work that takes about 55 bytes of
    memory for each of its own. Other columns are not read. An empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = arrow_text.strings(batch.column(1))
            for lo, hi in arrow_text.slices(column):
                names, root, height = fingerprint_slice(*arrow_text.raw(column[lo:hi]), level)
                ends = np.append(0, np.cumsum([len(x) for x in names])).astype(np.int32)
                flat = np.concatenate(names) if len(names) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(root.view(np.int64), mask=np.diff(ends) == 0), pa.array(height), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                    names=["id", "root", "height", "signatures"],
                )

    return arrow_text.mapped(texts, run, f"id {kind}, root bigint, height int, signatures array<bigint>").withColumnRenamed("id", id_col)
