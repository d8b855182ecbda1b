"""The whole document pipeline: decoded pages of many documents to questions, hierarchy, regions and text.

Every step is keyed by (doc_id, page_no) or doc_id. Null texts, blocks, drawings and images count as absent; a document
without questions has no question row, one without chapters no hierarchy row; an empty table gives empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LAYOUT, TEXT, Layout
from ..functions import geometry
from ..functions.text import strip, without_signature, without_trailing
from ..operators import classify, hierarchy, layout, lines, questions
from ..sources import tables

DOC, PAGE, KEY = "doc_id", "page_no", ["doc_id", "page_no"]


@dataclass
class Extraction:
    """questions (QUESTION), detections, chapters (nested), texts (doc_id, text) and summary (a row per document)."""

    questions: DataFrame
    detections: DataFrame
    chapters: DataFrame
    texts: DataFrame
    summary: DataFrame


def regions(pages: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """doc_id, page_no, tipo, rank, part, x0..y1: each page's tables, then its figures."""
    segments = tables.drawing_items(pages).withColumn("kind", geometry.segment_kind(long=cfg.line_min, flat=cfg.line_flat, thin=cfg.rect_flat))
    parts = {"tabla": layout.table_regions(segments, KEY, cfg), "figura": layout.figure_regions(tables.placements(pages), KEY, cfg)}
    return hierarchy.union_timeline(parts, [*KEY, "part", *tables.SIDES]).withColumnRenamed("kind", "tipo")


def texts(pages: DataFrame, excluded: DataFrame, share: float = TEXT.frequent_share) -> DataFrame:
    """doc_id, text: each document's lines outside the regions, without frequent and noise lines, stitched."""
    rows = geometry.without_regions(tables.text_lines(pages), excluded, KEY)
    raw = lines.page_texts(rows.select(*KEY, F.col("seq").alias("line_no"), F.col("text").alias("line")), KEY)
    split = lines.page_lines(raw, KEY)
    often = lines.frequent_lines(split, DOC, PAGE, share, pages.select(*KEY))
    return lines.stitch(lines.page_texts(lines.drop_noise(split, often, DOC), KEY), DOC, PAGE)


def headings(pages: DataFrame, excluded: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """The timeline of chapters, hinges and the questions whose numbers do not fall, with the state at each."""
    page_rows = layout.assemble_lines(tables.text_spans(pages), KEY, cfg)
    blocks = geometry.without_regions(layout.merge_bold(page_rows, KEY, cfg), excluded, KEY)
    starts = layout.question_starts(geometry.without_regions(page_rows, excluded, KEY))
    none = F.lit(None).cast("int")
    shape = [*KEY, *tables.SIDES]
    text = strip(F.col("text")).alias("text")
    chapters = blocks.where(layout.is_chapter(F.col("text"))).select(*shape, text, none.alias("num"), F.col("block_no").alias("seq"))
    found = layout.hinges(blocks, starts, pages, DOC, PAGE, cfg).select(*shape, text, none.alias("num"), F.col("block_no").alias("seq"))
    asked = hierarchy.continuity(starts, [DOC], [PAGE, "y0", "line_no"], "num").select(*shape, "text", "num", F.col("line_no").alias("seq"))
    events = hierarchy.union_timeline({"chapter": chapters, "hinge": found, "question": asked}, [*shape, "text", "num", "seq"])
    events = events.withColumn("bbox", F.array(*tables.SIDES)).withColumnRenamed(PAGE, "page")
    return hierarchy.timeline(events, [DOC], ORDER)


ORDER = ["page", "y0", "rank", "seq"]


def detections(found: DataFrame, events: DataFrame) -> DataFrame:
    """doc_id, page_no, tipo, pregunta, parte, png, x0..y1: regions with the question they follow and their part number.

    A region takes the last question at or above its upper edge; parts count per question and kind, page by page, tables
    first. Without a question the label is 000 and counts with a question 0.
    """
    asked = events.where("kind = 'question'").select(DOC, F.col("page").alias(PAGE), "y0", F.lit(0).alias("rank"), F.col("seq").alias("part"), F.lit(None).cast("string").alias("tipo"), "num", *(F.lit(None).cast("double").alias(s) for s in ("x0", "x1", "y1")))
    both = found.select(*KEY, "y0", (F.col("rank") + 1).alias("rank"), "part", "tipo", F.lit(None).cast("int").alias("num"), "x0", "x1", "y1").unionByName(asked)
    placed = hierarchy.asof_backward(both, [DOC], [PAGE, "y0", "rank", "part"], F.col("tipo").isNull(), "num", "pregunta").where("tipo is not null")
    placed = placed.withColumn("__label", hierarchy.label(F.col("pregunta"))).drop("num").withColumnRenamed("part", "__seq")
    numbered = hierarchy.number_parts(placed, [DOC, "__label", "tipo"], [PAGE, "rank", "__seq"]).withColumnRenamed("part", "parte")
    png = F.concat(F.lit("p"), F.col("__label"), F.lit("_parte"), F.format_string("%03d", "parte"), F.lit("_"), F.col("tipo"), F.lit(".png"))
    return numbered.select(*KEY, "tipo", "pregunta", "parte", png.alias("png"), *tables.SIDES)


def extract(pages: DataFrame, cfg: Layout = LAYOUT, share: float = TEXT.frequent_share) -> Extraction:
    """All outputs for decoded pages (sources.tables.PAGE, one row per page)."""
    found = regions(pages, cfg)
    events = headings(pages, found, cfg)
    whole = texts(pages, found, share)
    chapters = hierarchy.nested(events, [DOC], ORDER)
    place = hierarchy.lookup(events, [DOC], ORDER).withColumnRenamed("num", "numero")
    regions_of = detections(found, events)
    parts = hierarchy.gathered(regions_of.withColumnRenamed("pregunta", "numero"), [DOC, "numero"], ["tipo", "parte"], "tablas_figuras", ["tipo", "parte", "png"])
    titles = chapters.select(DOC, F.flatten(F.transform("chapters", lambda c: F.transform(c["hinges"], lambda h: h["text"]))).alias("__hinges"))
    rows = questions.split_questions(whole, DOC).join(titles, DOC, "left")
    rows = rows.withColumn("texto", without_trailing(without_signature(F.col("texto")), F.coalesce("__hinges", F.array().cast("array<string>"))))
    rows = hierarchy.with_default(rows, place, [DOC, "numero"], {"capitulo": ""})
    rows = hierarchy.with_default(rows, parts, [DOC, "numero"], {"tablas_figuras": F.array().cast("array<struct<tipo string, parte int, png string>>")})
    out = rows.select(DOC, "seq", "capitulo", "bisagra", "numero", "texto", "tablas_figuras")
    return Extraction(out, regions_of, chapters, whole, summary(pages, chapters, out, regions_of))


def summary(pages: DataFrame, chapters: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """A row per document: pages, capitulos, bisagras, preguntas, tablas, figuras, total_detections."""
    count = lambda df, name: df.groupBy(DOC).agg(F.count(F.lit(1)).alias(name))
    heads = chapters.select(DOC, F.size("chapters").alias("capitulos"), F.aggregate("chapters", F.lit(0), lambda n, c: n + F.size(c["hinges"])).alias("bisagras"))
    kinds = found.groupBy(DOC).agg(F.count_if(F.col("tipo") == "tabla").alias("tablas"), F.count_if(F.col("tipo") == "figura").alias("figuras"), F.count(F.lit(1)).alias("total_detections"))
    out = count(pages, "pages")
    for part in (heads, count(asked, "preguntas"), kinds):
        out = hierarchy.with_default(out, part, [DOC], {c: 0 for c in part.columns if c != DOC})
    return out.select(DOC, *(F.col(c).cast("long").alias(c) for c in ("pages", "capitulos", "bisagras", "preguntas", "tablas", "figuras", "total_detections")))


def artifacts(got: Extraction, taxonomy: DataFrame | None = None) -> DataFrame:
    """doc_id, name, text of every file that a run leaves: questions, their plain form, chapters, text, classified ones."""
    title = lambda df, name: df.select(DOC, F.lit(name).alias("name"), "text")
    chapters = got.chapters.select(DOC, F.to_json(F.struct("chapters")).alias("text"))
    out = title(tables.json_arrays(got.questions), "preguntas.json").union(title(questions.rendered(got.questions, DOC), "preguntas.txt"))
    out = out.union(title(chapters, "chapters_hinges.json")).union(title(got.texts, "texto_total.txt"))
    if taxonomy is not None:
        classified, detail, _ = classify.classify_questions(got.questions, taxonomy)
        out = out.union(title(tables.json_arrays(classified), "preguntas_clasificadas.json")).union(title(tables.json_arrays(detail), "preguntas_clasificadas_detalle.json"))
    return out


def process(pages: DataFrame, path: str, taxonomy: DataFrame | None = None) -> Extraction:
    """Runs everything on pages and writes the files as path/doc_id=<id>/name=<name>/part-*.txt."""
    got = extract(pages)
    artifacts(got, taxonomy).write.mode("overwrite").partitionBy(DOC, "name").text(path)
    return got
