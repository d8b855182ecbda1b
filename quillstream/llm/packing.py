"""Best-fit packing by a grouping genetic algorithm.

Documents become token pieces of at most ``capacity`` ids; full pieces are sequences of their own. The others are
dealt into blocks of bounded size. Every block has several islands, each a row of its own: a population of packings
that starts from best fit decreasing and random orders and evolves for some generations. Crossover injects whole
well-filled bins of one parent into another, bins of the receiver that hold one of their pieces are dissolved, and the
displaced pieces go back by best fit, longest first. After each epoch the islands are a written table, and each
island's best packing migrates to the next island by a join. Fewer bins are fitter, then more uneven ones, as an
almost empty bin leaves most to gain. Then the least filled bins of every block move up: an eighth of its bins, with at
most a quarter of its pieces, meets those of other blocks in fewer blocks of the same size, until one block is left
(or, with blocks of very few pieces, until less than half of them close).
Evolution is left out only where best fit needs no more bins than the lower bound of all that is left.

Null text is an empty document (its end id only). Null doc_ids and repeated rows are packed like any row. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from functools import cached_property
from itertools import chain
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, setup, written
from .tokens import encoded, tokenizer_path

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long, open boolean"


def _pieces(path: str, capacity: int):
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for docs, ids, offs in encoded(batches, path, most_bytes=8 << 20):
            raw = memoryview(ids.astype("<u4").tobytes())
            pieces = -(-np.diff(offs) // capacity)
            doc = np.repeat(np.arange(len(pieces)), pieces)
            piece = ragged(np.zeros_like(pieces), pieces)
            start = piece * capacity
            a = offs[:-1][doc] + start
            e = np.minimum(a + capacity, offs[1:][doc])
            crc = [zlib.crc32(raw[i:j]) for i, j in zip((4 * a).tolist(), (4 * e).tolist())]
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(doc)), *(pa.array(c, k) for c, k in zip((piece, start, e - a, crc), kinds[1:]))], names)

    return run


class Packing:
    """Bins of item numbers and how full each is; its fitness is asked only when it is complete."""

    def __init__(self, bins: list[list[int]], loads: list[int]):
        self.bins, self.loads = bins, loads

    @cached_property
    def fitness(self) -> tuple[int, int]:
        return -len(self.bins), sum(map(mul, self.loads, self.loads))

    def coded(self, n: int) -> bytes:
        """The bin of each of n items."""
        out = np.zeros(n, "<i4")
        out[list(chain.from_iterable(self.bins))] = np.repeat(np.arange(len(self.bins)), [len(b) for b in self.bins])
        return out.tobytes()


def decoded(code: bytes, size: list[int]) -> Packing:
    at = np.frombuffer(code, "<i4")
    items, ends = np.argsort(at, kind="stable").tolist(), np.cumsum(np.bincount(at)).tolist()
    bins = [items[i:j] for i, j in zip([0, *ends], ends)]
    return Packing(bins, [sum(map(size.__getitem__, b)) for b in bins])


def best_fit(found: Packing, items: list[int], size: list[int], capacity: int) -> Packing:
    """Puts items, in their order, each into the fullest bin that still takes it."""
    bins, loads = found.bins, found.loads
    # What a bin has free and, in the lower bits, its number: one small integer compares faster than a pair.
    low = (len(bins) + len(items)).bit_length()
    bin_of = (1 << low) - 1
    room = sorted((capacity - x) << low | k for k, x in enumerate(loads) if x < capacity)
    for i in items:
        n = size[i]
        at = bisect_left(room, n << low)
        if at == len(room):
            k, free = len(bins), capacity - n
            bins.append([i])
            loads.append(n)
        else:
            free = room.pop(at)
            k, free = free & bin_of, (free >> low) - n
            bins[k].append(i)
            loads[k] += n
        if free:
            insort(room, free << low | k)
    return found


def crossover(rng: random.Random, taker: Packing, giver: Packing, size: list[int], capacity: int) -> Packing:
    """taker with some of giver's best-filled bins injected."""
    order = sorted(range(len(giver.bins)), key=giver.loads.__getitem__, reverse=True)
    gift = [k for k in order[: max(1, len(order) // 2)] if rng.random() < 0.5] or order[:1]
    inside = set(chain.from_iterable([giver.bins[k] for k in gift]))
    child, displaced = Packing([giver.bins[k][:] for k in gift], [giver.loads[k] for k in gift]), []
    for b, load in zip(taker.bins, taker.loads):
        if inside.isdisjoint(b):
            child.bins.append(b[:])
            child.loads.append(load)
        else:
            displaced += [i for i in b if i not in inside]
    displaced.sort(key=size.__getitem__, reverse=True)
    return best_fit(child, displaced, size, capacity)


def mutate(rng: random.Random, person: Packing, size: list[int], capacity: int) -> Packing:
    """Dissolves the least filled bin and two others; person is given up."""
    bins, loads = person.bins, person.loads
    least = min(range(len(bins)), key=loads.__getitem__)
    gone = {least, *rng.sample(range(len(bins)), min(2, len(bins)))}
    loose = sorted((i for k in gone for i in bins[k]), key=size.__getitem__, reverse=True)
    held = [k for k in range(len(bins)) if k not in gone]
    return best_fit(Packing([bins[k] for k in held], [loads[k] for k in held]), loose, size, capacity)


def epoch(size: list[int], capacity: int, land: list[Packing], rng: random.Random, people: int, generations: int, least: int) -> list[Packing]:
    """An island's packings after some generations, fittest first; ends early at ``least`` bins."""
    down = sorted(range(len(size)), key=size.__getitem__, reverse=True)
    if not land:
        land = [best_fit(Packing([], []), down, size, capacity)]
    while len(land) < people and len(land[0].bins) > least:
        cut = rng.randrange(len(down))
        tail = down[cut:]
        rng.shuffle(tail)
        land.append(best_fit(Packing([], []), down[:cut] + tail, size, capacity))
    rank = lambda x: x.fitness
    land.sort(key=rank, reverse=True)
    for _ in range(generations):
        if len(land[0].bins) <= least or len(land) < 2:
            break
        a, b = land[0], rng.choice(land[1:])
        child = crossover(rng, a, b, size, capacity) if rng.random() < 0.5 else crossover(rng, b, a, size, capacity)
        land = sorted([*land[: people - 1], mutate(rng, child, size, capacity)], key=rank, reverse=True)
    return land


#: Islands that one task evolves; they are few bytes and much work, so sizes in bytes must not put them together.
ISLANDS_EACH = 4
ISLAND = "block long, island int, sizes binary, land array<binary>, bins long, spread long"


def _epoch(capacity: int, seed: int, people: int, generations: int, least: int):
    """One epoch of each row's island. least: bins that cannot be undercut if there is one block, else 0."""
    names, kinds = ["block", "island", "sizes", "land", "bins", "spread"], [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            for block, island, sizes, land in zip(*(b.column(c).to_pylist() for c in names[:4])):
                size = np.frombuffer(sizes, "<i4").tolist()
                rng = random.Random(f"{seed}:{block}:{island}:{len(land)}")
                got = epoch(size, capacity, [decoded(x, size) for x in land], rng, people, generations, least)
                best = got[0].fitness
                row = (block, island, sizes, [x.coded(len(size)) for x in got], -best[0], best[1])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return run


def _ordered(table):
    """A block's rows in an order of their own, as a shuffle gives them in any order."""
    return table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])


def _islands(islands: int):
    def run(table):
        sizes = _ordered(table).column("length").to_numpy().astype("<i4").tobytes()
        block = table.column("block")[0].as_py()
        return pa.table(
            [pa.array([block] * islands, pa.int64()), pa.array(range(islands), pa.int32()), pa.array([sizes] * islands, pa.binary()), pa.array([[]] * islands, pa.list_(pa.binary()))],
            names=["block", "island", "sizes", "land"],
        )

    return run


def _place(capacity: int, level: int, move: int):
    """Writes a block's best packing into its rows; ``move`` least filled bins or an eighth of all stay open (0: none)."""

    def run(table, best):
        table = _ordered(table)
        size = table.column("length").to_pylist()
        block = table.column("block")[0].as_py() if size else 0
        found = decoded(best.column("best")[0].as_py(), size) if len(best) else Packing([], [])
        order = sorted(range(len(found.bins)), key=lambda k: found.loads[k])
        number, offset, is_open = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size), bool)
        pieces = 0
        for rank, k in enumerate(order):
            b, at = found.bins[k], 0
            pieces += len(b)
            loose = found.loads[k] < capacity and rank < max(move, len(order) // 8) and (rank < 2 or pieces <= len(size) // 4) and move > 0
            for i in b:
                number[i], offset[i], is_open[i] = (level << 57) + (block << 21) + rank, at, loose
                at += size[i]
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, col in (("sequence_id", number), ("offset", offset), ("open", is_open)):
            out = out.append_column(name, pa.array(col))
        return out

    return run


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, per_block: int = 1500, move: int = 16, seed: int = 7, islands: int = 3, people: int = 8, epochs: int = 3, generations: int = 60
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    per_block: pieces in a block; move: bins that a small block hands on; people: packings on an island; generations:
    children of an island in an epoch.
    """
    setup(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(src.mapInArrow(_pieces(tokenizer or tokenizer_path(), capacity), PIECE), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    done, level, rows, before = [full], 0, pieces.where(F.col("length") < capacity), None
    while True:
        count, total = rows.agg(F.count(F.lit(1)), F.sum("length")).first()
        if not count:
            break
        n = -(-count // per_block)
        # Blocks of very few pieces could hand on most of them for ever.
        last = n == 1 or (before is not None and 2 * count > before)
        # Blocks of a level are dealt by a hash of their own, so pieces meet others than before.
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(n)))
        lands = dealt.groupBy("block").applyInArrow(_islands(islands), "block long, island int, sizes binary, land array<binary>")
        least = -(-total // capacity) if n == 1 else 0
        for e in range(epochs):
            lands = written(lands.repartition(-(-n * islands // ISLANDS_EACH), "block", "island").mapInArrow(_epoch(capacity, seed + e, people, generations, least), ISLAND), "islands")
            if e < epochs - 1:
                elite = lands.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("land")[0].alias("elite"))
                stay = F.slice("land", 1, max(1, people - 1))
                lands = lands.join(elite, ["block", "island"]).select("block", "island", "sizes", F.concat(stay, F.array("elite")).alias("land"))
        best = lands.groupBy("block").agg(F.max_by(F.col("land")[0], F.struct(-F.col("bins"), "spread", -F.col("island"))).alias("best"))
        packed = written(dealt.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_place(capacity, level, 0 if last else move), PACKED), "packed")
        done.append(packed.where("not open").drop("open"))
        if last:
            break
        rows, level, before = packed.where("open").select("doc_id", "piece", "start", "length", "ids_crc32"), level + 1, count
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
