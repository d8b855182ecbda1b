"""Page lines: frequent-line removal, noise, pages and documents put together again.

Null page texts count as empty pages; null keys are a document or page of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DIGIT, strip

#: Phrases of signature and validation lines.
NOISE = [
    "Para validar las firmas de este documento",
    "sea.gob.cl/validar",
    "validar las firmas",
    "https://validador.sea.gob.cl/validar",
    "Firmado Digitalmente",
    "sellodigital.sea.gob.cl",
    "Razón:",
    "Razon:",
]


def page_lines(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per line of each page: form feeds break lines, trailing carriage returns go; a blank page has one line."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\f"), F.lit("\n")), "\n")
    return pages.select(*key, F.posexplode(parts).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"\r+\z", ""))


def frequent_lines(lines: DataFrame, doc: str, page: str, share: float = 0.60, pages: DataFrame | None = None) -> DataFrame:
    """(doc, line, n) of stripped lines on at least max(2, share of all pages); empty pages count as pages.

    pages: doc, page of all pages, one row each, if at hand; otherwise they are counted from the lines.
    """
    pages = lines.select(doc, page).distinct() if pages is None else pages
    pages = pages.groupBy(F.col(doc).alias("__doc")).agg(F.count(F.lit(1)).alias("n_pages"))
    seen = lines.select(doc, page, strip(F.col("line")).alias("line")).where("line <> ''").distinct().groupBy(doc, "line").agg(F.count(F.lit(1)).alias("n"))
    both = seen.where("n >= 2").join(pages, F.col(doc).eqNullSafe(F.col("__doc")))
    return both.where(F.col("n") >= F.greatest(F.lit(2), (F.col("n_pages") * F.lit(share)).cast("int"))).select(doc, "line", "n")


def drop_noise(lines: DataFrame, frequent: DataFrame, doc: str, phrases: list[str] = NOISE) -> DataFrame:
    """Survivors, stripped; blank lines stay."""
    rows = lines.withColumn("line", strip(F.col("line")))
    noisy = F.lit(False)
    for p in phrases:
        noisy = noisy | F.contains(F.lower("line"), F.lit(p.lower()))
    rows = rows.where(~noisy & ~F.col("line").rlike(rf"^{DIGIT}{{1,4}}\z"))
    often = frequent.select(F.col(doc).alias("__doc"), F.col("line").alias("__line"))
    return rows.join(often, F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("line") == F.col("__line")), "left_anti")


def page_texts(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, text: each page's lines in the order of line_no, one under another."""
    rows = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("__l"))
    return rows.select(*key, F.array_join(F.transform("__l", lambda x: x["line"]), "\n").alias("text"))


def stitch(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """doc, text: stripped non-blank pages in order; a page that ends with a hyphen loses it and joins the next directly.

    One document is one row, so a document must fit a task. Documents without text are not returned.
    """
    rows = pages.select(doc, page, strip(F.col(text)).alias("__t")).where("__t <> ''").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "__t"))).alias("__p"))
    last = F.size("__p") - 1

    def joined(p, i):
        t = p["__t"]
        return F.when(i == last, t).when(F.endswith(t, F.lit("-")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(F.concat(t, F.lit("\n")))

    return rows.select(doc, F.array_join(F.transform("__p", joined), "").alias(text))
