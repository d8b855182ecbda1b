"""Training-order materialisation of token ids.

Documents are encoded and cut into sequences of at most ``stride`` ids (the last id of a document is the end id). The
sequences get dense numbers, partition by partition of a written table, and a keyed Feistel permutation with
cycle-walking sends each number to a global slot in 0..N-1. Rows ranged by slot are written as shards: one binary
block of ``per_shard`` slots, each of ``stride`` little-endian ids of ``width`` bytes padded with the pad id, so slot s
starts at byte (s mod per_shard) * stride * width of shard s div per_shard. Blocks are cells of a Parquet table, since
that is what Spark can write to any store; first_slot and end_slot are columns, so a reader that resumes at a slot
skips the row groups before it. The numbers of a run's layout (per_shard, stride, width) stand in every shard.

Null text is an empty document (its end id only), null doc_ids and repeated rows are written like others. An empty
table writes no shard; other columns are ignored. Ids that do not fit ``width`` bytes raise ValueError.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ragged, setup, shared_dir, written
from .tokens import encoded, encoder, tokenizer_path


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """The image of each number below n under a keyed permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}:{r}".encode())) for r in range(rounds)]

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f = f * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    walk = np.flatnonzero(out >= n)
    while len(walk):  # cycle-walking: images outside the domain go round again
        out[walk] = once(out[walk])
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def _sequences(path: str, stride: int, width: int):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["part", "at", "doc_id", "piece", "length", "ids"]

    def run(batches):
        part, at, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1).compress
        for docs, ids, offs in encoded(batches, path):
            if len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError(f"id {ids.max()} does not fit {width} bytes")
            raw = memoryview(ids.astype(f"<u{width}").tobytes())
            pieces = -(-np.diff(offs) // stride)
            doc = np.repeat(np.arange(len(pieces)), pieces)
            piece = ragged(np.zeros_like(pieces), pieces)
            start = offs[:-1][doc] + piece * stride
            end = np.minimum(start + stride, offs[1:][doc])
            squeezed = [pack(raw[a:e]) for a, e in zip((width * start).tolist(), (width * end).tolist())]
            cols = [np.full(len(doc), part), at + np.arange(len(doc)), docs.take(pa.array(doc)), piece, end - start, squeezed]
            at += len(doc)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def _slots(first, n: int, key: int, per_shard: int):
    """first: broadcast array of the number of each partition's first sequence."""

    def run(batches):
        for b in batches:
            number = first.value[b.column("part").to_numpy()] + b.column("at").to_numpy()
            slot = feistel(number, n, key) if len(number) else number
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // per_shard, pa.int64()), pa.array(slot, pa.int64()), *(b.column(c) for c in ("doc_id", "piece", "length", "ids"))], ["shard", "slot", "doc_id", "piece", "length", "ids"]
            )

    return run


SHARD = "shard long, first_slot long, end_slot long, per_shard int, stride int, width int, docs array<long>, pieces array<int>, lengths array<int>, data binary"


def _shards(stride: int, width: int, pad: int, per_shard: int):
    """Builds blocks from rows sorted by slot; a partition holds whole shards."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    names = ["shard", "first_slot", "end_slot", "per_shard", "stride", "width", "docs", "pieces", "lengths", "data"]
    blank = np.full(stride, pad, f"<u{width}").tobytes()

    def run(batches):
        unpack, shard, rows = zstandard.ZstdDecompressor(), None, []

        def block():
            data = b"".join(r[3] + blank[len(r[3]) :] for r in rows)
            first = shard * per_shard
            row = (shard, first, first + len(rows), per_shard, stride, width, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], data)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for b in batches:
            for s, d, p, n, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "piece", "length", "ids"))):
                if s != shard and rows:
                    yield block()
                    rows = []
                shard = s
                rows.append((d, p, n, unpack.decompress(ids, max_output_size=width * stride)))
        if rows:
            yield block()

    return run


def write_shards(docs: DataFrame, path: str, key: int = 2024, stride: int = 1024, per_shard: int = 512, pad: int = 0, tokenizer: str | None = None) -> int:
    """Writes the shards of docs as Parquet below path and returns the number of sequences.

    The driver learns how many sequences each input partition holds, eight bytes a partition.
    """
    spark = docs.sparkSession
    setup(spark)
    tokenizer = tokenizer or tokenizer_path()
    width = 2 if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 else 4
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(src.mapInArrow(_sequences(tokenizer, stride, width), "part int, at long, doc_id long, piece int, length int, ids binary"), "sequences")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row per task
    sizes = np.zeros(max(counts.column("part").to_pylist(), default=-1) + 1, np.int64)
    sizes[counts.column("part").to_numpy()] = counts.column("n").to_numpy()
    first, n = spark.sparkContext.broadcast(np.cumsum(sizes) - sizes), int(sizes.sum())
    placed = rows.mapInArrow(_slots(first, max(n, 1), key, per_shard), "shard long, slot long, doc_id long, piece int, length int, ids binary")
    placed.repartitionByRange("shard").sortWithinPartitions("slot").mapInArrow(_shards(stride, width, pad, per_shard), SHARD).write.parquet(path)
    return n


def _read(batches):
    names = ["doc_id", "piece", "length", "slot", "shard", "byte_offset", "ids_crc32"]
    for b in batches:
        for shard, first, stride, width, docs, pieces, lengths, data in zip(*(b.column(c).to_pylist() for c in ("shard", "first_slot", "stride", "width", "docs", "pieces", "lengths", "data"))):
            at = np.arange(len(docs), dtype=np.int64) * stride * width
            ids = memoryview(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
            crc = [zlib.crc32(ids[a : a + 4 * m]) for a, m in zip((at // width * 4).tolist(), lengths)]
            cols = [(docs, pa.int64()), (pieces, pa.int32()), (lengths, pa.int32()), (first + np.arange(len(docs)), pa.int64()), ([shard] * len(docs), pa.int64()), (at, pa.int64()), (crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in cols], names)


def read_shards(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """doc_id, piece, length, slot, shard, byte_offset, ids_crc32 of the slots from from_slot on."""
    setup(spark)
    shards = spark.read.schema(SHARD).parquet(path).where(F.col("end_slot") > from_slot)
    return shards.mapInArrow(_read, "doc_id long, piece int, length int, slot long, shard long, byte_offset long, ids_crc32 long").where(F.col("slot") >= from_slot)


def op6_shards(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_shards(spark, path)
