"""What the corpus operators share: plan sizing, checkpoints, connected components, byte helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def setup(spark: SparkSession) -> None:
    """Small Arrow batches, so that very long texts never pile up in one Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if not spark.conf.get("spark.checkpoint.dir", ""):
        if spark.sparkContext.getCheckpointDir() is None:
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstream-"))
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    import uuid

    setup(spark)
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once.

    narrow: rows are a few numbers, so at most four files a core are written instead of one per shuffle partition.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if narrow:
        df = df.coalesce(max(8, 4 * spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_hint(df: DataFrame) -> int:
    """Estimated bytes of df from the optimizer's statistics; no job is run. Only used to size partitions."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 64 << 20


def hot_join(left: DataFrame, right: DataFrame, on: str | list[str], size, how: str = "inner", most_hot: int = 2000) -> DataFrame:
    """left joined with right, whose rows have distinct keys, without gathering a frequent key in one task.

    size: a column of right that says how many rows of left have its key, or a table of the keys and their number n.
    Keys with more than 1 / most_hot of all rows are at most most_hot; they alone are broadcast, their rows of left are
    salted and their row of right is repeated per salt. What holds the sizes should be a written table, as it is read
    several times.
    """
    on = [on] if isinstance(on, str) else list(on)
    sized = size.select(*on, F.col("n").cast("long").alias("__n")) if isinstance(size, DataFrame) else right.select(*on, size.cast("long").alias("__n"))
    total = sized.agg(F.sum("__n")).first()[0] or 0
    part = max(1000, -(-total // most_hot))
    hot = F.broadcast(sized.where(F.col("__n") > part).select(*on, F.expr(f"cast(ceil(__n / {part}) as int)").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    a = left.join(hot, on, "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("__salts")
    b = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def blocks_for(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """How many blocks of about bytes_each df makes."""
    return max(least, -(-size_hint(df) // bytes_each))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many lines below it as no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def lower_az(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as one UTF-8 byte array and its offsets; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Union:
    """Union-find over a bounded set of keys; the smallest key names each class."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, root = self.up, x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of edges (a, b): component is the smallest reachable node.

    Alternating large and small stars; every round is two aggregations with map-side combine and two joins
    against one row per node, so a hub is never gathered in one task. Self-loops are ignored, nodes without
    a link are not returned, null ends are ignored, repeated edges count once.
    """
    spark = edges.sparkSession
    setup(spark)

    def tidy(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = written(tidy(edges), "links", narrow=True)
    was, now = None, mark(links)
    while was != now:
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tidy(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        links = written(tidy(small), "links", narrow=True)
        was, now = now, mark(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
