"""A corpus pipeline of five corpus operators.

Stages take (spark, docs, sf_dir), work on all rows of docs and return documents columns, the last one the packed
pieces. The first stage judges rows one by one and gives each a key of its own (``__row``); the others choose rows by
it, so documents with a null or a repeated doc_id are treated like any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import exact_dedup, langid, minhash_dedup, mixing, packing
from quillstream.llm.common import unused, written


#: Key of a row. It rises with doc_id, and rows without one come first.
ROW = "__row"
#: Scores of language ID: from which a prediction is sure, and below which an ambiguous one says nothing.
SURE, LEAST = 0.8, 0.5
#: White space between tokens, as mixing counts them.
SPACE = r"[\x20\x09-\x0D]"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, a number of each row's own; spread over tasks also where many rows have one doc_id or none."""
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    rows = rows.orderBy(F.col("doc_id").cast("long").asc_nulls_first(), F.xxhash64("text"), ROW)
    return rows.withColumn(ROW, F.monotonically_increasing_id())


def _only(docs: DataFrame, key, keep: DataFrame) -> DataFrame:
    """The rows of docs whose key is among the doc_ids of keep."""
    name = unused(docs, "__id")
    return docs.join(keep.select(F.col("doc_id").alias(name)), key == F.col(name), "left_semi")


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Judges each row and numbers the rows.

    Texts without a letter are rejected. A prediction is sure from a score of SURE on, if it is not ambiguous and the
    model chose among several languages; it then replaces a lang that is missing or that the model knows. A missing
    lang becomes the predicted one also where it is not sure, but a text without lang whose prediction is ambiguous
    and scores below LEAST is rejected. Where nothing could be learned, texts with letters stay as they are.
    """
    pred, score, unsure, letters = names = [unused(docs, f"__{n}") for n in ("pred", "score", "unsure", "letters")]
    said, langs = langid.tagged(docs, names)
    fitted = F.lit(len(langs) > 1)
    sure = fitted & (F.col(score) >= SURE) & ~F.col(unsure) & (F.col("lang").isNull() | F.col("lang").isin(langs))
    unclear = fitted & F.col("lang").isNull() & F.col(unsure) & (F.col(score) < LEAST)
    lang = F.when(sure, F.col(pred)).otherwise(F.coalesce("lang", F.when(F.col(pred) != "und", F.col(pred))))
    return _numbered(said.where(F.col(letters) & ~unclear).withColumn("lang", lang).select(docs.columns))


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts stays, that with the largest doc_id; one without doc_id if none has any."""
    key = F.col(ROW)
    return _only(docs, key, exact_dedup.exact_dedup(docs.withColumn("doc_id", key)).where("kept"))


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest doc_id; rows without doc_id come last."""
    key = F.when(F.col("doc_id").isNull(), F.col(ROW) + F.lit(1 << 62)).otherwise(F.col(ROW))
    return _only(docs, key, minhash_dedup.near_dedup(docs.withColumn("doc_id", key), shingle=5).where("kept or n_shingles = 0"))


def _first_words(text, n):
    """text up to the end of its n-th word; it must have more."""
    lead = F.when(text.rlike(rf"^{SPACE}"), 1).otherwise(0)
    rest = F.element_at(F.split(text, f"{SPACE}+", (n + lead + 1).cast("int")), -1)
    return F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), f"{SPACE}+\\z", "")


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture of four fifths of all tokens takes: of each leaf's last document the token prefix it grants."""
    taken = mixing.mix(docs, tenths=8, epochs=1, also=[ROW]).where("tokens_taken > 0")
    key, held, given = (unused(docs, f"__{n}") for n in ("id", "held", "given"))
    taken = taken.select(F.col(ROW).alias(key), F.col("n_tokens").alias(held), F.col("tokens_taken").alias(given))
    rows = docs.join(taken, F.col(ROW) == F.col(key))
    cut = F.col(given) < F.col(held)
    rows = rows.withColumn("text", F.when(cut, _first_words(F.col("text"), F.col(given))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut & F.col("n_chars").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mixture), ("packing", packed)]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
