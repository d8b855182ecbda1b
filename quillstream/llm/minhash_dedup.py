"""Near-dedup by circulant MinHash.

A document's set holds the distinct hashes of its ``shingle``-word runs (lower-cased A-Z, words
``[^\\x20\\x09-\\x0D]+``; a shorter text is one run, a text without words has an empty set and links with nothing).
Equal sets are one class. Of every class one permutation of the hash ring places the shingles, a second one, shifted
by k places, gives coordinate k of the signature; ``bands`` bands of ``rows`` coordinates make the buckets. A pair
at the threshold 0.8 misses all buckets with probability below 1e-7.

Documents of a bucket are first compared with its smallest one (exact Jaccard on full sets), and links give
components. Those in buckets that still hold several components are dealt into new buckets of ``strict_bands`` bands
of ``strict_rows`` further coordinates (miss below 1e-7 again), which part documents that merely share a passage. In
each, the documents outside the largest component are asked against all the others, tile by tile, so no pair of a
bucket that could still join two components is left out, and only links leave a tile, never pairs.

Shingles are told apart by 64-bit hashes; the first permutation is a bijection of these hashes of which the leading 32
bits are kept. Joins on a bucket or a text are salted where these are frequent.

A null doc_id links with nothing (component null, kept false). Rows that repeat a doc_id each take the component of
their own text; texts of which the same doc_id is the smallest count as one document, linked if any of them is. Empty
tables give empty results; other columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Union, components, hot_join, ragged, setup, text_buffer, written

U, V = np.uint64, np.uint32


class Words(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = Words()


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and the size of each set."""
    words, n = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.lower().split()
        words += w
        n[i] = len(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    at = np.concatenate([[0], np.cumsum(n)])
    run = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        run = mix64(run * U(0x9E3779B97F4A7C15) + h[j : j + len(run)])
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, m in enumerate(n.tolist()):
        if not m:
            continue
        if m < k:
            v = np.full(1, m, np.uint64)
            for x in h[at[i] : at[i + 1]]:
                v = mix64(v * U(0x9E3779B97F4A7C15) + x)
        else:
            v = np.sort(run[at[i] : at[i + 1] - k + 1])
            if m > k:
                v = v[np.concatenate([[True], v[1:] != v[:-1]])]
        out.append(v)
        sizes[i] = len(v)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray, coordinates: int, first: int = 0) -> np.ndarray:
    """Circulant MinHash coordinates of each non-empty set: permute once, then permute again after first + k shifts."""
    place = (mix64(sets + U(0x5851F42D4C957F2D)) >> U(32)).astype(V)
    out = np.zeros((len(sizes), coordinates), V)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):  # runs of sets that stay in cache
        j = i + 1
        begin = ends[i] - sizes[i]
        while j < len(sizes) and ends[j] - begin <= 1 << 15:
            j += 1
        x = place[begin : ends[j - 1]]
        starts = ends[i:j] - sizes[i:j] - begin
        buf, tmp = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            np.add(x, V(first + k), out=buf)
            np.multiply(buf, V(0x9E3779B1), out=buf)
            np.right_shift(buf, V(15), out=tmp)
            np.bitwise_xor(buf, tmp, out=buf)
            np.multiply(buf, V(0x85EBCA77), out=buf)
            np.right_shift(buf, V(13), out=tmp)
            np.bitwise_xor(buf, tmp, out=buf)
            np.multiply(buf, V(0xC2B2AE3D), out=buf)
            np.right_shift(buf, V(16), out=tmp)
            np.bitwise_xor(buf, tmp, out=buf)
            out[i:j, k] = np.minimum.reduceat(buf, starts)
        i = j
    return out


def band_codes(sets: np.ndarray, sizes: np.ndarray, bands: int, rows: int, first: int = 0) -> np.ndarray:
    """A 64-bit code per set and band."""
    sig = signatures(sets, sizes, bands * rows, first).astype(np.uint64).reshape(len(sizes), bands, rows)
    h = np.arange(bands, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + np.zeros((len(sizes), 1), np.uint64)
    for r in range(rows):
        h = mix64(h ^ sig[:, :, r]) + U(r)
    return h.view(np.int64)


def _texts(b):
    raw, off = text_buffer(b.column("text"))
    raw, off = raw.tobytes(), off.tolist()
    return [raw[i:j] for i, j in zip(off, off[1:])]


def _runs(b, texts, most=1 << 20):
    """Slices of the batch with about most bytes of text."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (held == 0 or held + len(texts[end]) <= most):
            held += len(texts[end])
            end += 1
        yield at, end
        at = end


def _sign(k: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            texts = _texts(b)
            for s, e in _runs(b, texts):
                sets, sizes = shingle_sets(texts[s:e], k)
                has = np.flatnonzero(sizes)
                h = band_codes(sets, sizes[has], bands, rows)
                keys, codes, at = [None] * (e - s), [None] * (e - s), 0
                for m, i in enumerate(has.tolist()):
                    keys[i] = xxhash.xxh3_128_digest(sets[at : at + sizes[i]].tobytes())
                    at += sizes[i]
                    codes[i] = h[m].tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s, e - s), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "codes"]
                )

    return run


def _pack(batches):
    """Lower-cased words of each text, one space apart, compressed: a fraction of the bytes of its shingle set; null without words."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        words = [b" ".join(t.lower().split()) for t in _texts(b)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([squeeze(w) if w else None for w in words], pa.binary())], ["doc_id", "words"])


def _unpacked(column, k: int, most: int = 1 << 20):
    """Slices (first, end, sets, sizes) of packed texts, about most bytes of text each."""
    open_ = zstandard.ZstdDecompressor().decompress
    texts, held, at = [], 0, 0
    for i, v in enumerate(column):
        texts.append(open_(v.as_buffer()))
        held += len(texts[-1])
        if held >= most or i == len(column) - 1:
            yield (at, i + 1, *shingle_sets(texts, k))
            texts, held, at = [], 0, i + 1


def _sets(column, k: int) -> list[np.ndarray]:
    """The shingle set of each packed text."""
    out = []
    for _, _, sets, sizes in _unpacked(column, k):
        out += np.split(sets, np.cumsum(sizes)[:-1])
    return out


def _strict(k: int, bands: int, rows: int, first: int):
    def run(batches):
        for b in batches:
            for at, end, sets, sizes in _unpacked(b.column("words"), k):
                h = band_codes(sets, sizes, bands, rows, first)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, end - at), pa.array(h.tolist(), pa.list_(pa.int64()))], ["doc_id", "codes"])

    return run


def _confirm(k: int, percent: int):
    def run(batches):
        for b in batches:
            a, c, good = b.column("a").to_pylist(), b.column("b").to_pylist(), []
            sets = _sets(b.column("wa"), k)
            held = centre = None
            for i, p in enumerate(sets):
                packed = b.column("wb")[i]
                if packed != held:  # rows of one centre mostly follow each other
                    held, (centre,) = packed, _sets([packed], k)
                q = centre
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
                if 100 * both >= percent * (len(p) + len(q) - both) and both:
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([c[i] for i in good], pa.int64())], ["a", "b"])

    return run


def _shared(rowset: DataFrame) -> DataFrame:
    """The rows of buckets with several members; buckets with the same members are one (count, ends, sums of hashes)."""
    sums = [F.sum(F.shiftright(F.xxhash64("doc_id", F.lit(s)), 24)).alias(f"f{s}") for s in (1, 2)]
    found = rowset.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *sums)
    found = written(found.where("lo <> hi").groupBy("m", "lo", "hi", "f1", "f2").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "buckets", narrow=True)
    return hot_join(rowset, found, "bucket", F.col("m")).drop("m")


def _open(members: DataFrame, part: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with their component as part."""
    rows = members.join(part.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    rows = written(rows, "parted", narrow=True)
    mixed = rows.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y")
    return hot_join(rows, written(mixed.select("bucket", "m"), "mixed", narrow=True), "bucket", F.col("m")).drop("m")


def _tiles(live: DataFrame, packed: DataFrame, k: int, percent: int, tile: int) -> DataFrame:
    """Links that join components of one bucket.

    Documents outside a bucket's largest component are asked against all its others, in tiles of about tile by
    four tiles documents, so a bucket of any size is spread over tasks; only links leave a tile.
    """
    live = written(live.select("bucket", "doc_id", "part"), "live", narrow=True)
    count = live.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("bucket").agg(F.sum("m").alias("m"), F.max(F.struct("m", "part")).alias("x"))
    count = count.select("bucket", F.col("x.part").alias("main"), F.expr(f"cast(ceil(m / {4 * tile}) as int)").alias("across"), F.expr(f"cast(ceil((m - x.m) / {tile}) as int)").alias("down"), F.col("m").alias("size"))
    rows = hot_join(live, written(count, "tiles", narrow=True), "bucket", F.col("size")).drop("size")
    lot = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    members = rows.select("bucket", "doc_id", F.lit(False).alias("asks"), F.explode(F.expr("sequence(0, down - 1)")).alias("i"), (lot % F.col("across")).cast("int").alias("j"))
    askers = rows.where("part <> main").select("bucket", "doc_id", F.lit(True).alias("asks"), (lot % F.col("down")).cast("int").alias("i"), F.explode(F.expr("sequence(0, across - 1)")).alias("j"))
    both = members.union(askers).join(packed.select("doc_id", "part", "words"), "doc_id")
    return written(both.groupBy("bucket", "i", "j").applyInArrow(_ask(k, percent), "a long, b long"), "links")


def _ask(k: int, percent: int):
    def run(table):
        asks = np.array(table.column("asks").to_pylist(), bool)
        ids, part = table.column("doc_id").to_pylist(), table.column("part").to_pylist()
        sets = _sets(table.column("words"), k)
        others = np.flatnonzero(~asks)
        sizes = np.array([len(sets[i]) for i in others], np.int64)
        whole = np.concatenate([sets[i] for i in others]) if len(others) else np.zeros(0, np.uint64)
        order = np.argsort(whole, kind="stable")
        whole, owner = whole[order], np.repeat(np.arange(len(others)), sizes)[order]
        forest, out = Union(), ([], [])
        for c in np.flatnonzero(asks).tolist():
            q = sets[c]
            lo, hi = np.searchsorted(whole, q, "left"), np.searchsorted(whole, q, "right")
            both = np.bincount(owner[ragged(lo, hi - lo)], minlength=len(others))
            for o in np.flatnonzero(100 * both >= percent * (len(q) + sizes - both)).tolist():
                if forest.join(part[c], part[others[o]]):
                    out[0].append(ids[c])
                    out[1].append(ids[others[o]])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, strict_bands: int = 96, strict_rows: int = 8, tile: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links need a Jaccard similarity of percent/100."""
    spark = docs.sparkSession
    setup(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(src.mapInArrow(_sign(shingle, bands, rows), "doc_id long, n_shingles long, key binary, codes array<long>"), "signed")
    classes = signed.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "codes")).alias("r"), F.count(F.lit(1)).alias("rows")).select("key", "rows", "r.*")
    classes = written(classes, "classes")
    rowset = classes.select("doc_id", "n_shingles", F.explode("codes").alias("bucket"))
    members = written(_shared(rowset), "members", narrow=True)
    asked = members.select("doc_id").distinct()
    # Packed before the join: texts travel as compressed words, and sets are made where they are compared. The ids asked
    # for grow with the table, so they are never broadcast: the plan is the same at every size.
    packed = written(src.mapInArrow(_pack, "doc_id long, words binary").where("words is not null").join(asked.hint("merge"), "doc_id", "left_semi"), "packed")
    # Every bucket's documents against its smallest one.
    top = members.groupBy("bucket").agg(F.min(F.struct("doc_id", "n_shingles")).alias("c"), F.count(F.lit(1)).alias("m")).select("bucket", "m", F.col("c.doc_id").alias("b"), F.col("c.n_shingles").alias("nb"))
    pairs = hot_join(members, written(top, "tops", narrow=True), "bucket", F.col("m")).where(f"doc_id <> b and 100 * least(n_shingles, nb) >= {percent} * greatest(n_shingles, nb)")
    pairs = pairs.select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()
    both = pairs.join(packed.withColumnsRenamed({"doc_id": "a", "words": "wa"}), "a").join(packed.withColumnsRenamed({"doc_id": "b", "words": "wb"}), "b")
    links = written(both.select("a", "b", "wa", "wb").mapInArrow(_confirm(shingle, percent), "a long, b long"), "links")
    part = written(components(links), "parts", narrow=True)
    left = _open(members, part)
    # What stars leave apart: documents that share much but may not be alike. Stricter bands on further coordinates.
    few = written(left.groupBy("doc_id").agg(F.first("part").alias("part")).join(packed, "doc_id"), "few")
    codes = few.mapInArrow(_strict(shingle, strict_bands, strict_rows, bands * rows), "doc_id long, codes array<long>")
    fresh = written(_shared(codes.select("doc_id", F.explode("codes").alias("bucket"))), "strict")
    links = links.union(_tiles(_open(fresh, part), few, shingle, percent, tile))
    part = written(components(links), "parts", narrow=True)
    rep = classes.select("key", "rows", F.col("doc_id").alias("node"))
    rep = written(rep.join(part, "node", "left").select("key", "rows", F.coalesce("component", "node").alias("c")), "classes", narrow=True)
    out = hot_join(signed.select("doc_id", "n_shingles", "key"), rep, "key", F.col("rows"), "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
