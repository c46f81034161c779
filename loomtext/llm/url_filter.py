"""Allow and block entries for URLs, the most specific entry deciding.

An entry is a host, which covers its subdomains, and optionally a path, which covers what lies below it:
``example.org``, ``news.example.org/sports``. Entries form a trie over reversed host labels and then path segments. Of
all entries that cover a URL, that with more host labels wins, then that with more path segments; at equal depth a block
beats an allow.

The trie is a few flat arrays: the labels, an edge for each (node, label), and each node's entry. A batch of URLs walks
it together, a level at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.storage import fresh

#: With more bytes of entries than this the trie isn't broadcast: URLs' prefixes are joined with the entries instead, to
#: the same result. The trie itself takes less than twice these bytes and 24 for each label of each entry.
MAX_BROADCAST_BYTES = 16 << 20
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def keys(url: Column) -> tuple[Column, Column]:
    """Reversed host labels and path segments; no labels for what isn't an absolute URL."""
    some = lambda x: F.filter(x, lambda y: y != "")
    return F.reverse(some(F.split(F.lower(F.regexp_extract(url, HOST, 1)), r"\."))), some(F.split(F.regexp_extract(url, PATH, 1), "/"))


class Trie:
    """Of rows ``(host labels, path segments, action, entry)``; the node 0 is the root.

    Node ``n``'s child by ``labels[k]`` is the node ``child[i]`` where ``edge[i] = 2 * (n * len(labels) + k) + kind``;
    ``kind`` is 1 for path segments. ``entry`` and ``block`` hold the number of a node's entry, or -1, and whether it blocks.
    """

    def __init__(self, rows):
        self.labels = pa.array(sorted({x for host, path, *_ in rows for x in (*host, *path)}), pa.string())
        number = {x: i for i, x in enumerate(self.labels.to_pylist())}
        size, edges, best = len(number), {}, {}
        self.names = pa.array([r[3] for r in rows], pa.string())
        for i, (host, path, action, entry) in enumerate(rows):
            node = 0
            for kind, parts in ((0, host), (1, path)):
                for part in parts:
                    node = edges.setdefault(2 * (node * size + number[part]) + kind, len(edges) + 1)
            mine = (action != "block", entry, i)
            best[node] = min(mine, best.get(node, mine))
        key = np.fromiter(edges.keys(), np.int64, len(edges))
        order = key.argsort()
        self.edge, self.child = key[order], np.fromiter(edges.values(), np.int32, len(edges))[order]
        self.entry, self.block = np.full(len(edges) + 1, -1, np.int32), np.zeros(len(edges) + 1, bool)
        for node, (allows, _, i) in best.items():
            self.entry[node], self.block[node] = i, not allows

    def nbytes(self) -> int:
        return self.labels.nbytes + self.names.nbytes + self.edge.nbytes + self.child.nbytes + self.entry.nbytes + self.block.nbytes

    def _down(self, nodes: np.ndarray, labels: np.ndarray, kind: int) -> np.ndarray:
        """The children of ``nodes`` by ``labels``, or -1."""
        key = 2 * (nodes.astype(np.int64) * len(self.labels) + labels) + kind
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where((nodes >= 0) & (labels >= 0) & (self.edge[at] == key), self.child[at], -1)

    def find(self, hosts: pa.ListArray, paths: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Each URL's entry, or -1, and whether it blocks."""
        n = len(hosts)
        found = np.zeros(n, np.int32)
        if len(self.edge) == 0:
            return np.full(n, -1, np.int32), np.zeros(n, bool)
        (h, h0, hn), (p, p0, pn) = self._numbered(hosts), self._numbered(paths)
        alive, node, depth = np.arange(n), np.zeros(n, np.int32), 0
        while len(alive := alive[depth < hn[alive]]):
            node[alive] = self._down(node[alive], h[h0[alive] + depth], 0)
            alive = alive[node[alive] >= 0]
            found[alive] = np.where(self.entry[node[alive]] >= 0, node[alive], found[alive])
            # From this host down the path, whose entries beat those of shorter hosts.
            walk, below, k = alive, node[alive], 0
            while len(walk):
                more = k < pn[walk]
                walk, below = walk[more], below[more]
                below = self._down(below, p[p0[walk] + k], 1)
                walk, below, k = walk[below >= 0], below[below >= 0], k + 1
                found[walk] = np.where(self.entry[below] >= 0, below, found[walk])
            depth += 1
        return self.entry[found], self.block[found]

    def _numbered(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The labels' numbers (-1 for one that no entry has), and each list's first place and length."""
        numbers = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), self.labels), -1).to_numpy(zero_copy_only=False)
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.append(numbers, -1), np.append(0, length.cumsum())[:-1], length


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, action, entry`` of the distinct ``urls`` that an entry covers, by joining prefixes with the entries.

    Only prefixes of a depth that some entry has are looked at.
    """
    first = F.min_by(F.struct("action", "entry"), F.struct(F.col("action") != "block", "entry"))
    rules = rules.groupBy("h", "p").agg(first.alias("b"))
    depths = [(int(a), int(b)) for a, b in rules.select(F.size("h"), F.size("p")).distinct().collect()]
    host, path = keys(F.col("url"))
    steps = urls.select("url", host.alias("host"), path.alias("path")).where(F.size("host") > 0)
    some = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(depths)]) if depths else F.expr("cast(array() AS array<struct<a: int, b: int>>)")
    steps = steps.select("url", "host", "path", F.explode(F.filter(some, lambda d: (d["a"] <= F.size("host")) & (d["b"] <= F.size("path")))).alias("d"))
    steps = steps.select("url", F.slice("host", 1, F.col("d.a")).alias("h"), F.slice("path", 1, F.col("d.b")).alias("p"))
    best = F.max_by("b", F.struct(F.size("h"), F.size("p")))
    return steps.join(rules, ["h", "p"]).groupBy("url").agg(best.alias("b")).select("url", "b.action", "b.entry")


def judged(pages: DataFrame, entries: DataFrame, url_col: str = "url", action_col: str = "action", entry_col: str = "entry", default: str = "allow", max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``pages`` with the action (``allow`` or ``block``) for each URL and the entry that decided it.

    ``entries`` holds ``entry`` and ``action``. Hosts compare without case, paths with it; scheme, user, port, query
    and fragment don't matter, nor do empty labels and segments. Of equal entries a block counts, then the first in
    order. An entry without a host, with a null or with another action is ignored. A null, relative or malformed URL,
    and one that no entry covers, gets ``default`` and a null entry. All rows and columns stay, repeated rows and very
    long URLs among them; columns named like the two added are replaced. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    pages = pages.drop(action_col, entry_col)
    whole = F.when(F.col("entry").contains("://"), F.col("entry")).otherwise(F.concat(F.lit("http://"), F.col("entry")))
    host, path = keys(whole)
    rules = entries.where("entry IS NOT NULL AND action IN ('allow', 'block')").select(host.alias("h"), path.alias("p"), "action", "entry").where(F.size("h") > 0).distinct()
    # Read up to the limit only, to learn whether it is passed.
    held = rules.agg(F.sum(F.octet_length("entry") + 24 * (F.size("h") + F.size("p")))).first()[0] or 0
    url_, host_, path_, found_ = fresh([*pages.columns, action_col, entry_col], "url", "host", "path", "found")
    names = [F.col(f"`{c}`") for c in pages.columns]
    if held > max_broadcast:
        found = _joined(pages.select(F.col(f"`{url_col}`").alias("url")).where("url IS NOT NULL").distinct(), rules).select(F.col("url").alias(url_), F.struct("action", "entry").alias(found_))
        both = pages.join(found, F.col(f"`{url_col}`") == F.col(url_), "left")
        return both.select(*names, F.coalesce(F.col(found_)["action"], F.lit(default)).alias(action_col), F.col(found_)["entry"].alias(entry_col))
    shared = spark.sparkContext.broadcast(Trie(sorted((tuple(r) for r in rules.collect()), key=lambda r: (r[3], r[2]))))

    @F.arrow_udf("action string, entry string")
    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        which, blocks = shared.value.find(hosts, paths)
        none = which < 0
        action = pc.if_else(pa.array(none), pa.scalar(default), pc.if_else(pa.array(blocks), pa.scalar("block"), pa.scalar("allow")))
        return pa.StructArray.from_arrays([action, shared.value.names.take(pa.array(which, mask=none))], names=["action", "entry"])

    host, path = keys(F.col(f"`{url_col}`"))
    wide = pages.select("*", F.coalesce(host, F.array()).alias(host_), F.coalesce(path, F.array()).alias(path_))
    wide = wide.select(*names, judge(F.col(host_), F.col(path_)).alias(found_))
    return wide.select(*names, F.col(found_)["action"].alias(action_col), F.col(found_)["entry"].alias(entry_col))
