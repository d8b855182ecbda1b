"""Timelines: as-of joins, running filters, chapter and hinge state, lookups, part numbering.

Ties in the given order are broken arbitrarily: put a unique column last. Null keys form a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def continuity(df: DataFrame, by: list[str], order: list, number: str) -> DataFrame:
    """Keeps rows whose number is not below the last kept one: the running maximum, as kept numbers never fall."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__m", F.max(number).over(w)).where(F.col(number) >= F.coalesce("__m", F.lit(-1))).drop("__m")


def monotonic(numbers: Column, drop: int = 5) -> Column:
    """Numbers of an ordered array that survive: one is dropped if it falls by drop or more below the last kept one.

    The fold runs in an Arrow function, as a native one would copy its array at every step. Nulls are left out.
    """
    return F.udf(lambda xs: None if xs is None else survivors(xs, drop), "array<long>", useArrow=True)(numbers.cast("array<long>"))


def survivors(numbers, drop: int) -> list[int]:
    out: list[int] = []
    for n in numbers:
        if n is not None and not (out and out[-1] - n >= drop):
            out.append(n)
    return out


def timeline(df: DataFrame, by: list[str], order: list, kind: str = "kind", text: str = "text") -> DataFrame:
    """chapter_no, chapter, hinge_no and hinge in force at each event.

    A chapter resets the hinge, hinges before any chapter are ignored; numbers count from 1 in each group and chapter.
    """
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("chapter_no", F.sum((F.col(kind) == "chapter").cast("long")).over(w))
    df = df.withColumn("chapter", F.last(F.when(F.col(kind) == "chapter", F.col(text)), ignorenulls=True).over(w))
    inner = W.partitionBy(*by, "chapter_no").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    is_hinge = (F.col(kind) == "hinge") & (F.col("chapter_no") > 0)
    df = df.withColumn("hinge_no", F.sum(is_hinge.cast("long")).over(inner))
    return df.withColumn("hinge", F.last(F.when(is_hinge, F.col(text)), ignorenulls=True).over(inner))


def nested(events: DataFrame, by: list[str], order: list[str], page: str = "page", box: str = "bbox", number: str = "num") -> DataFrame:
    """by, chapters: each group's chapters with their questions, hinges (with questions) and questions without hinge.

    events: a timeline() with page, bbox and number. Chapters and hinges without questions stay; a group without
    chapters has no row.
    """
    is_kind = lambda k: F.col("kind") == k
    head = lambda k: F.max(F.when(is_kind(k), F.struct(F.col(page).alias("page"), F.col("text").alias("text"), F.col(box).alias("bbox"))))
    numbers = lambda c: F.transform(c, lambda x: x["__n"])
    asked = F.array_sort(F.collect_list(F.when(is_kind("question"), F.struct(*order, F.col(number).alias("__n")))))
    hinges = events.where("chapter_no > 0").groupBy(*by, "chapter_no", "hinge_no").agg(head("hinge").alias("__hinge"), head("chapter").alias("__c"), asked.alias("__q"))
    group = hinges.groupBy(*by, "chapter_no").agg(
        F.max("__c").alias("__c"),
        F.array_sort(F.flatten(F.collect_list("__q"))).alias("__q"),
        F.max(F.when(F.col("hinge_no") == 0, F.col("__q"))).alias("__free"),
        F.array_sort(F.collect_list(F.when(F.col("hinge_no") > 0, F.struct("hinge_no", "__hinge", numbers(F.col("__q")).alias("questions"))))).alias("__h"),
    )
    parts = lambda c: [c[f].alias(f) for f in ("page", "text", "bbox")]
    hinge = F.transform("__h", lambda h: F.struct(*parts(h["__hinge"]), h["questions"].alias("questions")))
    chapter = F.struct("chapter_no", *parts(F.col("__c")), numbers(F.col("__q")).alias("questions"), hinge.alias("hinges"), numbers(F.col("__free")).alias("questions_without_hinge"))
    rows = group.groupBy(*by).agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))
    return rows.withColumn("chapters", F.transform("chapters", lambda c: c.dropFields("chapter_no")))


def lookup(events: DataFrame, by: list[str], order: list[str], number: str = "num") -> DataFrame:
    """by, number, capitulo, bisagra: of questions with one number the last by chapter, those without hinge after the
    hinges', then by hinge and place."""
    at = F.struct("chapter_no", (F.col("hinge_no") == 0).alias("__free"), "hinge_no", *order)
    asked = events.where("kind = 'question' and chapter_no > 0")
    return asked.groupBy(*by, number).agg(F.max_by("chapter", at).alias("capitulo"), F.max_by("hinge", at).alias("bisagra"))


def asof_backward(df: DataFrame, by: list[str], order: list, is_right: Column, value: str, name: str) -> DataFrame:
    """Adds the value of the last right row at or before each row of the union."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(is_right, F.col(value)), ignorenulls=True).over(w))


def asof_forward(df: DataFrame, by: list[str], order: list, is_right: Column, value: str, name: str) -> DataFrame:
    """Adds the value of the first right row at or after each row of the union."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    return df.withColumn(name, F.first(F.when(is_right, F.col(value)), ignorenulls=True).over(w))


def with_next(df: DataFrame, key: list[str], step: str, offset=1) -> DataFrame:
    """The rows for which df has a row with the same key and step + offset: an adjacent semi join."""
    after = df.select(*(F.col(k).alias(f"__{k}") for k in key), F.col(step).alias("__step")).distinct()
    same = F.col(step) + offset == F.col("__step")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(after, same, "left_semi")


def with_default(left: DataFrame, right: DataFrame, key: list[str], defaults: dict) -> DataFrame:
    """left with right's columns by key; where there is no row or a null, the defaults' values."""
    out = left.join(right, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in defaults.items()})


def gathered(rows: DataFrame, key: list[str], order: list[str], name: str, fields: list[str] | None = None) -> DataFrame:
    """key, name: each key's rows as an array of structs sorted by order; rows with a null key are left out."""
    present = rows.dropna(subset=key)
    out = present.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *(f for f in (fields or []) if f not in order)))).alias(name))
    return out if not fields else out.withColumn(name, F.transform(name, lambda x: F.struct(*(x[f].alias(f) for f in fields))))


def union_timeline(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """kind, rank and columns of all parts in one table; rank is a part's position, the tiebreak at equal places."""
    out = None
    for rank, (kind, df) in enumerate(parts.items()):
        part = df.select(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def number_parts(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Running part number in each group."""
    return df.withColumn("part", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def label(number: Column) -> Column:
    """Three digits at least; 000 for none."""
    return F.format_string("%03d", F.coalesce(number, F.lit(0)))


def last_write(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
