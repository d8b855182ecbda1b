"""Sources of the document pipeline: decoded pages, questions, taxonomies, and the sinks of its outputs.

A decoded page is one row of PAGE. Null blocks, drawings, images, spans and texts count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

_SPANS = "spans array<struct<text string, font string, flags int, bbox array<double>>>"
PAGE = (
    f"doc_id string, page_no int, page_height double, blocks array<struct<type int, lines array<struct<bbox array<double>, {_SPANS}>>>>, "
    "drawings array<struct<items array<struct<op string, p array<double>>>>>, images array<struct<rects array<array<double>>>>"
)
QUESTION = "doc_id string, seq int, capitulo string, bisagra string, numero int, texto string, tablas_figuras array<struct<tipo string, parte int, png string>>"
#: One question of a document's JSON array.
RECORD = "capitulo string, bisagra string, numero int, texto string, tablas_figuras array<struct<tipo string, parte int, png string>>"
KEY = ["doc_id", "page_no"]
SIDES = ("x0", "y0", "x1", "y1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _box(c: Column) -> list[Column]:
    return [c[k].alias(s) for k, s in enumerate(SIDES)]


def _each(df: DataFrame, keep: list, nested: Column, at: str, item: str) -> DataFrame:
    return df.select(*keep, F.posexplode(nested).alias(at, item))


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, block_no, line_no, line (struct) of the blocks of type 0."""
    rows = _each(pages, KEY, F.col("blocks"), "block_no", "b").where("b.type = 0")
    return _each(rows, [*KEY, "block_no"], F.col("b.lines"), "line_no", "line")


def text_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, seq, text, x0..y1: each line's spans joined as they stand, with the line's box."""
    text = F.array_join(F.transform("line.spans", lambda s: F.coalesce(s["text"], F.lit(""))), "")
    return page_lines(pages).select(*KEY, F.struct("block_no", "line_no").alias("seq"), F.coalesce(text, F.lit("")).alias("text"), *_box(F.col("line.bbox")))


def text_spans(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, seq, text, is_bold, x0..y1: trimmed spans that are not empty; the font's name or flag bit 16 says bold."""
    rows = _each(page_lines(pages), [*KEY, "block_no", "line_no"], F.col("line.spans"), "span_no", "s")
    bold = F.coalesce(F.lower("s.font").contains("bold"), F.lit(False)) | F.coalesce(F.col("s.flags").bitwiseAND(16) != 0, F.lit(False))
    out = rows.select(*KEY, F.struct("block_no", "line_no", "span_no").alias("seq"), strip(F.col("s.text")).alias("text"), bold.alias("is_bold"), *_box(F.col("s.bbox")))
    return out.where("text <> ''")


def drawing_items(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, seq, op, x1, y1, x2, y2 of lines ('l') and rectangles ('re'); other items are left out."""
    rows = _each(pages, KEY, F.col("drawings"), "drawing_no", "d")
    rows = _each(rows, [*KEY, "drawing_no"], F.col("d.items"), "item_no", "i").where("i.op in ('l', 're')")
    return rows.select(*KEY, F.struct("drawing_no", "item_no").alias("seq"), F.col("i.op").alias("op"), *(F.col("i.p")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


def placements(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, seq, x0..y1 of every place an image stands at."""
    rows = _each(pages, KEY, F.col("images"), "image_no", "i")
    rows = _each(rows, [*KEY, "image_no"], F.col("i.rects"), "rect_no", "r")
    return rows.select(*KEY, F.struct("image_no", "rect_no").alias("seq"), *_box(F.col("r")))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pages of the PDF files under path; the optional package ``pymupdf`` must be installed on all workers.

    A missing path raises, a file that cannot be decoded fails its task.
    """
    import importlib.util

    if importlib.util.find_spec("pymupdf") is None:
        raise ImportError("decoding PDF files needs the optional package pymupdf")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_decoded, PAGE)


def _decoded(batches):
    import pandas as pd
    import pymupdf

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            doc = pymupdf.open(stream=bytes(content), filetype="pdf")
            rows = [(path.rsplit("/", 1)[-1], k + 1, page.rect.height, *_layout(page)) for k, page in enumerate(doc)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "page_height", "blocks", "drawings", "images"])


def _layout(page) -> tuple[list, list, list]:
    spans = lambda x: [{"text": s.get("text"), "font": s.get("font"), "flags": int(s.get("flags", 0)), "bbox": [float(v) for v in s["bbox"]]} for s in x.get("spans", [])]
    lines = lambda b: [{"bbox": [float(v) for v in x["bbox"]], "spans": spans(x)} for x in b.get("lines", [])]
    blocks = [{"type": b.get("type"), "lines": lines(b)} for b in page.get_text("dict").get("blocks", [])]
    point = lambda i: [float(v) for p in i[1:3] for v in p] if i[0] == "l" else [float(v) for v in i[1]]
    drawings = [{"items": [{"op": i[0], "p": point(i)} for i in d.get("items", []) if i[0] in ("l", "re")]} for d in page.get_drawings()]
    return blocks, drawings, [{"rects": [[float(v) for v in r] for r in page.get_image_rects(i[0])]} for i in page.get_images(full=True)]


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """QUESTION rows of files that hold one JSON array each; doc_id is the name of the folder above the file.

    A missing path raises; a file that is no array of records has no rows.
    """
    parts = F.split("path", "/")
    files = spark.read.format("binaryFile").load(path).select(F.element_at(parts, -2).alias("doc_id"), F.decode("content", "UTF-8").alias("t"))
    rows = files.select("doc_id", F.posexplode(F.from_json("t", f"array<struct<{RECORD}>>")).alias("seq", "q"))
    return rows.select("doc_id", "seq", "q.*")


def taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """topic_pos, topic_id, topic_name, kw_pos, keyword of a JSON object id -> {nombre, keywords}, in its order."""
    import json

    text = spark.read.text(path, wholetext=True).first()[0]
    topics = json.loads(text)
    rows = [(p, i, t["nombre"], k, w) for p, (i, t) in enumerate(topics.items()) for k, w in enumerate(t["keywords"])]
    return spark.createDataFrame(rows, "topic_pos int, topic_id string, topic_name string, kw_pos int, keyword string")


def json_arrays(rows: DataFrame, by: str = "doc_id", order: str = "seq") -> DataFrame:
    """by, text: each document's rows as one JSON array in the order of seq, without these two columns."""
    fields = [c for c in rows.columns if c not in (by, order)]
    got = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("__j")))).alias("__j"))
    return got.select(by, F.concat(F.lit("[\n"), F.array_join(F.transform("__j", lambda x: x["__j"]), ",\n"), F.lit("\n]")).alias("text"))


def write_texts(texts: DataFrame, path: str, by: str = "doc_id", text: str = "text") -> None:
    """One folder per document, named by its id, with the text in it."""
    texts.select(by, text).write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)
