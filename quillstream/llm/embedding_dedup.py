"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated onto principal axes fitted on a bounded sample (``fit_rows``; a rotation
changes no cosine, so the sample affects speed only). The sample is halved along the leading axes in turn, which gives
tiles; each tile's box holds its rows' extent on the leading axes. A row is sent to the pairs of its own tile with
every tile whose box it could reach at the threshold. In a pair of tiles, block by block, the products of the leading
dimensions are accumulated step by step; after each step the product of the suffix norms bounds what the rest can add
(Cauchy-Schwarz), and rows and columns without a pair that can still reach the threshold are left out of the next step.
The last step is in double precision. A tile pair returns link counts per row and a spanning forest of its links, never
its pairs. Equal vectors are one node with a multiplicity throughout.

A tile has at most about ``tile`` rows; small tables have ``tiles`` tiles. Where the axes carry equal variance no box
bound holds and all tiles meet: a row then travels once per tile and comparisons grow with the square of the table.

Vectors that are null, zero or hold null or non-finite components, and rows with a null vec_id, link with nothing
and are their own component (kept false where vec_id is null). Vectors of different lengths never link. Repeated
rows count as other vectors; different vectors under one vec_id are nodes of their own, each with its own links, and
the component is the smallest vec_id in it. An empty table gives an empty result; other columns (labels too) are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Union, components, hot_join, setup, written


def _vectors(kind: str):
    """kind: how components are kept, as 4-byte floats where the table has these, else as doubles."""

    def run(batches):
        for b in batches:
            ids, keys, blobs = b.column("vec_id"), [], []
            for i, v in zip(ids.to_pylist(), b.column("embedding").to_pylist()):
                key = blob = None
                if i is not None and v and None not in v:
                    x = np.array(v, kind) + np.zeros(1, kind)  # -0.0 becomes 0.0
                    if np.isfinite(x).all() and x.any():
                        blob = x.tobytes()
                        key = xxhash.xxh3_128_digest(blob)
                keys.append(key)
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], ["vec_id", "key", "vec"])

    return run


def unit(blobs: list[bytes], dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares of huge and tiny components in range
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Tiles:
    """Halvings of a sample along its axes in turn; every cut is a node (axis, value, below, above), a leaf a number."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.n = 0
        self.root = self.split(points, leaves, 0)

    def split(self, x: np.ndarray, leaves: int, axis: int):
        if leaves < 2 or len(x) < 2:
            self.n += 1
            return self.n - 1
        low = leaves // 2
        cut = float(np.quantile(x[:, axis], low / leaves))
        below, nxt = x[:, axis] <= cut, (axis + 1) % x.shape[1]
        return axis, cut, self.split(x[below], low, nxt), self.split(x[~below], leaves - low, nxt)

    def of(self, x: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(node, int):
                out[rows] = node
            else:
                axis, cut, below, above = node
                left = x[rows, axis] <= cut
                stack += [(below, rows[left]), (above, rows[~left])]
        return out


def _placed(axes: np.ndarray, tiles: Tiles, kind: str):
    """Adds each row's tile and its leading coordinates."""

    def run(batches):
        for b in batches:
            blobs = b.column("vec").to_pylist()
            p = unit(blobs, len(axes), kind) @ axes if blobs else np.zeros((0, axes.shape[1]))
            lead = pa.array(p.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("mult"), b.column("vec"), pa.array(tiles.of(p), pa.int64()), lead], ["node", "mult", "vec", "tile", "lead"])

    return run


def _reaching(low: np.ndarray, high: np.ndarray, present: np.ndarray, gap: float):
    """Sends each row to the tile pairs that it could have a link in. low, high: the tiles' boxes."""

    def run(batches):
        for b in batches:
            p = np.array(b.column("lead").to_pylist()).reshape(b.num_rows, low.shape[1])
            tile = b.column("tile").to_numpy()
            far = np.zeros((len(p), len(low)))
            for k in range(low.shape[1]):
                x = p[:, k : k + 1]
                far += np.maximum(0.0, np.maximum(low[:, k] - x, x - high[:, k])) ** 2
            row, other = np.nonzero((far <= gap * gap) & present)
            at = pa.array(row)
            own = tile[row]
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(at) for c in ("node", "mult", "vec")] + [pa.array(own), pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other))], ["node", "mult", "vec", "tile", "a", "b"]
            )

    return run


def _compare(axes: np.ndarray, threshold: float, steps: tuple, kind: str, rows_at_once: int = 256, columns_at_once: int = 8192):
    dim = len(axes)
    steps = tuple(s for s in steps if s < dim)

    def run(key, table):
        a, b = (k.as_py() for k in key)
        tile = table.column("tile").to_numpy()
        ids, mult = table.column("node").to_numpy(), table.column("mult").to_numpy().astype(np.float64)
        x = unit(table.column("vec").to_pylist(), dim, kind)
        y = (x @ axes).astype(np.float32)
        rest = [np.sqrt(np.maximum(0.0, 1.0 - (y[:, :s].astype(np.float64) ** 2).sum(1))).astype(np.float32) for s in steps]
        left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        count, forest, edges = np.zeros(len(ids)), Union(), []

        def linked(rows, columns):
            """Rows and columns that may hold links, and which of their pairs do."""
            held, done = np.zeros((len(rows), len(columns)), np.float32), 0
            for s, norm in zip(steps, rest):
                held += y[rows, done:s] @ y[columns, done:s].T
                may = held + norm[rows][:, None] * norm[columns][None, :] >= threshold - 1e-4
                r, c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
                if not len(r):
                    return rows[:0], columns[:0], None
                rows, columns, held, done = rows[r], columns[c], held[np.ix_(r, c)], s
            hit = x[rows] @ x[columns].T >= threshold
            return rows, columns, hit & (rows[:, None] < columns[None, :]) if a == b else hit

        def join(u, v):
            if forest.join(u, v):
                edges.append((u, v))

        for i in range(0, len(left), rows_at_once):
            for j in range(0, len(right), columns_at_once):
                rows, columns, hit = linked(left[i : i + rows_at_once], right[j : j + columns_at_once])
                if hit is None or not hit.any():
                    continue
                count[rows] += hit @ mult[columns]
                count[columns] += mult[rows] @ hit
                # Each row's and column's first link first; of the others only pairs of classes still apart remain.
                for u in np.flatnonzero(hit.any(1)).tolist():
                    join(int(rows[u]), int(columns[hit[u].argmax()]))
                first = hit.argmax(0)
                for v in np.flatnonzero(hit.any(0)).tolist():
                    join(int(rows[first[v]]), int(columns[v]))
                roots = [np.array([forest.find(u) for u in some.tolist()]) for some in (rows, columns)]
                for u, v in zip(*np.nonzero(hit & (roots[0][:, None] != roots[1][None, :]))):
                    join(int(rows[u]), int(columns[v]))
        some = np.flatnonzero(count)
        one, two = [u for u, _ in edges], [v for _, v in edges]
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[some], ids[one]]) if len(some) else np.zeros(0, np.int64), pa.int64()),
                "n": pa.array(np.concatenate([count[some], np.zeros(len(one))]).astype(np.int64), pa.int64()),
                "other": pa.array([None] * len(some) + ids[two].tolist(), pa.int64()),
            }
        )

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, tile: int = 32_768, tiles: int = 8, steps: tuple = (16, 32), fit_rows: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. fit_rows: bound of the sample that axes and tiles are fitted on;
    steps: after how many leading dimensions the bound is tried."""
    spark = vectors.sparkSession
    setup(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    rows = written(src.mapInArrow(_vectors(kind), "vec_id long, key binary, vec binary"), "vectors")
    reps = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("mult"), F.first("vec").alias("vec"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    sizes = [r.n for r in reps.select(F.octet_length("vec").alias("n")).distinct().collect()]
    found = None
    for size in sorted(sizes):
        part = _links(reps.where(F.octet_length("vec") == size), size // int(kind[-1]), kind, threshold, tile, tiles, steps, fit_rows)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, other long")
    found = written(found, "links")
    links = found.where("other is null").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    part = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = written(part.join(reps.select("node", "low"), "node"), "parts", narrow=True)
    lowest = written(named.groupBy("component").agg(F.min("low").alias("c"), F.count(F.lit(1)).alias("size")), "lowest", narrow=True)
    named = hot_join(named.select("node", "component"), lowest, "component", F.col("size")).select("node", "c")
    info = reps.select("key", "node", "low", "mult").join(links, "node", "left").join(named, "node", "left")
    info = written(info.select("key", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("c", "low").alias("c")), "info", narrow=True)
    out = hot_join(rows.select("vec_id", "key"), info, "key", F.col("mult"), "left")
    comp = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def _links(reps: DataFrame, dim: int, kind: str, threshold: float, tile: int, tiles: int, steps: tuple, fit_rows: int) -> DataFrame:
    """Counts (other null) and forest edges between distinct vectors of one dimension."""
    n = reps.count()
    lot = F.shiftrightunsigned(F.xxhash64("key"), 11) / float(1 << 53)
    sample = reps.where(lot < min(1.0, fit_rows / max(n, 1))).select("vec").limit(fit_rows).collect()
    sample = sample or reps.select("vec").limit(1).collect()
    x = unit([bytes(r.vec) for r in sample], dim, kind)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = np.ascontiguousarray(axes[:, ::-1])
    lead = np.ascontiguousarray(axes[:, : min(max(steps, default=dim), 16, dim)])
    cut = Tiles(x @ lead, max(1, min(tiles, n // 64), -(-n // tile)))
    placed = written(reps.mapInArrow(_placed(lead, cut, kind), "node long, mult long, vec binary, tile long, lead array<double>"), "placed")
    # Two numbers per axis and tile, a tile being tens of thousands of rows.
    ends = [f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(lead.shape[1]) for name, f in (("l", F.min), ("h", F.max))]
    low, high, present = np.zeros((cut.n, lead.shape[1])), np.zeros((cut.n, lead.shape[1])), np.zeros(cut.n, bool)
    for r in placed.groupBy("tile").agg(*ends).collect():
        present[r.tile] = True
        for k in range(lead.shape[1]):
            low[r.tile, k], high[r.tile, k] = r[f"l{k}"], r[f"h{k}"]
    gap = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    sent = placed.mapInArrow(_reaching(low, high, present, gap), "node long, mult long, vec binary, tile long, a long, b long")
    return sent.groupBy("a", "b").applyInArrow(_compare(axes, threshold, steps, kind), "id long, n long, other long")


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
