"""Exact dedup by Patricia tries whose terminals own the identifier that stays.

Documents are equal when their texts agree after lower-casing A-Z. Map side: every task inserts whole byte
strings into compressed radix tries, one per (length, slice of the content hash); a terminal holds the smallest
and the largest identifier and the number of rows. Above ``buffer_bytes`` the largest subtrees are spilled as
partial rows. Partials are shuffled by (length, content hash) and meet in a second trie per such key, so a text
that fills a third of the table arrives as a few rows per map task. Owners are joined back by SHA-256;
adaptive execution splits the rows of a frequent text, as nothing but the join follows in that stage.

Null and empty texts are the same (empty) text. Rows with a null doc_id count in group_size and never stay;
a group of only such rows has keep_id null. Repeated rows of the doc_id that stays are all marked kept.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import setup, text_buffer

PARTIAL = "length long, hash long, text binary, low long, high long, n long"
OWNERS = "text_sha256 string, low long, high long, group_size long"


class Terminal:
    __slots__ = ("low", "high", "n")

    def __init__(self):
        self.low = self.high = None
        self.n = 0

    def add(self, low, high, n):
        if low is not None and (self.low is None or low < self.low):
            self.low = low
        if high is not None and (self.high is None or high > self.high):
            self.high = high
        self.n += n


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving on slices that compare in C."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Patricia:
    """Compressed radix trie over byte strings; ``held`` counts the bytes of its edges."""

    __slots__ = ("label", "below", "end", "held")

    def __init__(self, label: bytes = b""):
        self.label, self.below, self.end, self.held = label, {}, None, len(label)

    def insert(self, key: bytes) -> tuple[Terminal, int]:
        """The terminal of key, and how many bytes the trie grew by."""
        path, node, at, grown = [], self, 0, 0
        while True:
            path.append(node)
            if at == len(key):
                break
            child = node.below.get(key[at])
            if child is None:
                leaf = Patricia(key[at:])
                node.below[key[at]] = leaf
                grown, node = len(key) - at, leaf
                break
            m = shared_prefix(child.label, key[at : at + len(child.label)])
            if m < len(child.label):
                fork = Patricia(child.label[:m])
                fork.held = child.held
                child.label = child.label[m:]
                child.held -= m
                fork.below[child.label[0]] = child
                node.below[key[at]] = fork
                child = fork
            node, at = child, at + m
        for x in path:
            x.held += grown
        if node.end is None:
            node.end = Terminal()
        return node.end, grown

    def terminals(self, before: bytes = b"") -> Iterator[tuple[bytes, Terminal]]:
        stack = [(self, before)]
        while stack:
            node, head = stack.pop()
            head += node.label
            if node.end is not None:
                yield head, node.end
            stack += [(x, head) for x in node.below.values()]


def _partials(batches, buffer_bytes: int, slices: int):
    tries: dict[tuple[int, int], Patricia] = {}
    held = 0

    def rows(found):
        cols = [[], [], [], [], [], []]
        for text, t in found:
            h = xxhash.xxh3_64_intdigest(text) - (1 << 63)
            for c, v in zip(cols, (len(text), h, text, t.low, t.high, t.n)):
                c.append(v)
            if len(cols[0]) >= 500 or sum(map(len, cols[2][-1:])) > 4 << 20:
                yield batch(cols)
                cols = [[], [], [], [], [], []]
        if cols[0]:
            yield batch(cols)

    def batch(cols):
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["length", "hash", "text", "low", "high", "n"])

    for b in batches:
        raw, off = text_buffer(b.column("text"))
        raw, off = raw.tobytes().lower(), off.tolist()
        for i, doc in enumerate(b.column("doc_id").to_pylist()):
            text = raw[off[i] : off[i + 1]]
            slot = (len(text), xxhash.xxh3_64_intdigest(text) % slices)
            root = tries.get(slot)
            if root is None:
                root = tries[slot] = Patricia()
            end, grown = root.insert(text)
            end.add(doc, doc, 1)
            held += grown
        if held > buffer_bytes:
            # Spill whole subtrees below the roots, the largest first, until half the buffer is free.
            subtrees = sorted(((c.held, s, k) for s, r in tries.items() for k, c in r.below.items()), key=lambda x: -x[0])
            for size, slot, first in subtrees:
                if held <= buffer_bytes // 2:
                    break
                yield from rows(tries[slot].below.pop(first).terminals())
                tries[slot].held -= size
                held -= size
            tries = {s: r for s, r in tries.items() if r.below or r.end is not None}
    for root in tries.values():
        yield from rows(root.terminals())


def _merge(batches):
    key, root, out = None, None, []

    def flush():
        cols = [[], [], [], []]
        for text, t in out:
            for c, v in zip(cols, (text, t.low, t.high, t.n)):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.int64()])], ["text_sha256", "low", "high", "group_size"])

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("length", "hash", "text", "low", "high", "n")]
        for length, h, text, low, high, n in zip(*cols):
            if (length, h) != key:
                if root is not None:
                    out += [(hashlib.sha256(s).hexdigest(), t) for s, t in root.terminals()]
                key, root = (length, h), Patricia()
            root.insert(text)[0].add(low, high, n)
        if len(out) > 2000:
            yield flush()
            out = []
    if root is not None:
        out += [(hashlib.sha256(s).hexdigest(), t) for s, t in root.terminals()]
    yield flush()


def _digests(batches):
    for b in batches:
        raw, off = text_buffer(b.column("text"))
        raw, off = raw.tobytes().lower(), off.tolist()
        sha = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(off, off[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sha, pa.string())], ["doc_id", "text_sha256"])


def exact_dedup(docs: DataFrame, keep: str = "largest", buffer_bytes: int = 24 << 20, slices: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. keep: ``largest`` or ``smallest``."""
    setup(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partial = src.mapInArrow(lambda it: _partials(it, buffer_bytes, slices), PARTIAL)
    owners = partial.repartition("length", "hash").sortWithinPartitions("length", "hash").mapInArrow(_merge, OWNERS)
    owner = owners.select("text_sha256", F.col("high" if keep == "largest" else "low").alias("keep_id"), "group_size")
    rows = src.mapInArrow(_digests, "doc_id long, text_sha256 string")
    return rows.join(owner, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, false) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
