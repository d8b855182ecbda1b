"""Page geometry: order-dependent steps on one page's rows at a time, and the page's gates and predicates as columns.

A page's rows are sorted next to each other and stream through Python, so one page must fit a task and pages spread over
tasks whatever their number. Rows that are already dealt out by the page's key are not shuffled again; those that already
stand together (as rows do that one row was exploded into) need not be sorted by Spark either.
Null texts count as empty. Rows with equal sort keys keep the order of ``seq``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import LAYOUT, Layout
from ..functions import geometry
from ..functions.text import DIGIT, SPACE, strip

BOX = "x0 double, y0 double, x1 double, y1 double"
SIDES = ("x0", "y0", "x1", "y1")


def per_page(rows: DataFrame, key: list[str], order: list[str], fields: list[str], run, result: str, together: bool = False) -> DataFrame:
    """key and the fields of result: what run makes of whole pages' rows, sorted by order.

    run: from the Arrow arrays of fields and the numbers of the pages' first rows to each made row's page and its columns.
    together: the caller has put each page's rows next to each other in one partition; only pages that are out of order
    are sorted, in Python. Keys are then no floating numbers.
    """
    made = StructType.fromDDL(result)
    schema = StructType(rows.select(*key).schema.fields + made.fields)
    if together:
        held = [*fields, *(o for o in order if o not in fields)]
        cut = rows.select(*key, *(F.col(f).alias(f"__{f}") for f in held))
        return cut.mapInArrow(_pages(len(key), len(fields), run, result, [len(key) + held.index(o) for o in order]), schema)
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    numbered = rows.select(*key, *(F.col(f).alias(f"__{f}") for f in fields), at.alias("__at"))
    return numbered.mapInArrow(_pages(len(key), len(fields), run, result), schema)


ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _turns(c: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are alike."""
    a, b = c.slice(1), c.slice(0, len(c) - 1)
    out = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return out | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)) if c.null_count else out


def _rank(v):
    """Sorts as Spark does: nulls first, NaN last, structs by their fields."""
    if isinstance(v, dict):
        return 1, tuple(_rank(x) for x in v.values())
    return (0,) if v is None else (2,) if v != v else (1, v)


def _in_order(rows: pa.RecordBatch, starts: np.ndarray, order: list[int]) -> pa.RecordBatch:
    """rows with each page sorted by the columns numbered in order; whole numbers that rise are only looked at."""
    first = rows.column(order[0])
    if pa.types.is_integer(first.type) and not first.null_count:
        n = first.to_numpy()
        rising = n[1:] > n[:-1]
        rising[starts[1:] - 1] = True
        if rising.all():
            return rows
    ranks = [tuple(map(_rank, r)) for r in zip(*(rows.column(k).to_pylist() for k in order))]
    at = [k for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(ranks)]) for k in sorted(range(i, j), key=ranks.__getitem__)]
    return rows.take(pa.array(at))


def _pages(n_keys: int, n_fields: int, run, result: str, order: list[int] | None = None):
    """Cuts the stream of rows where pages begin; holds the rows of one page and one batch.

    order: None if rows are sorted and their last column numbers them, else the columns to sort a page by.
    """
    names, kinds = zip(*(r.split() for r in result.split(", ")))

    def begun(b, before=None):
        """The rows that begin a page; before: a row that the first follows."""
        if order is None:
            return np.flatnonzero(b.column(b.num_columns - 1).to_numpy() == 1)
        new = np.zeros(len(b), bool)
        new[:1] = before is None
        for k, c in enumerate(b.columns[:n_keys]):
            turns = _turns(c if before is None else pa.concat_arrays([before.column(k), c]))
            new[len(b) - len(turns) :] |= turns
        return np.flatnonzero(new)

    def outcome(held):
        """held: batches of whole pages."""
        (rows,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        starts = begun(rows)
        if order is not None:
            rows = _in_order(rows, starts, order)
        columns = rows.columns
        pages, made = run(columns[n_keys : n_keys + n_fields], starts)
        at = pa.array(starts[np.asarray(pages, np.int64)])
        made = [v if isinstance(v, pa.Array) else pa.array(v, ARROW[k]) for v, k in zip(made, kinds)]
        return pa.RecordBatch.from_arrays([*(k.take(at) for k in columns[:n_keys]), *made], [*rows.schema.names[:n_keys], *names])

    def stream(batches):
        held: list = []
        before = None
        for b in batches:
            if not len(b):
                continue
            starts = begun(b, before)
            before = b.slice(len(b) - 1)
            if len(starts):  # all pages before the last start are whole
                if last := int(starts[-1]):
                    held.append(b.slice(0, last))
                if held:
                    yield outcome(held)
                held, b = [], b.slice(last)
            held.append(b)
        if held:
            yield outcome(held)

    return stream


def _one_by_one(run, n_made: int):
    """run for per_page from one that makes tuples of the list of a page's rows."""

    def pages(columns, starts):
        rows = list(zip(*(c.to_pylist() for c in columns)))
        at, got = [], []
        for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(rows)])):
            more = run(rows[i:j])
            got += more
            at += [k] * len(more)
        return at, list(zip(*got)) if got else [[]] * n_made

    return pages


def _sided(rows: DataFrame) -> DataFrame:
    return rows.withColumns({s: F.col(s).cast("double") for s in SIDES})


def near(a, b, gap: float) -> bool:
    return max(0.0, a[0] - b[2], b[0] - a[2]) <= gap and max(0.0, a[1] - b[3], b[1] - a[3]) <= gap


def around(a, b) -> tuple:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def _absorbed(boxes: list[tuple], r: tuple, gap: float) -> bool:
    """Whether the first of boxes near r took it in."""
    for k, m in enumerate(boxes):
        if near(m, r, gap):
            boxes[k] = around(m, r)
            return True
    return False


def close_rects(rects: list[tuple], gap: float) -> list[tuple]:
    """The bounding boxes of the transitive closure of nearness, boxes counting as rectangles.

    The first pass takes rectangles in their order; then sweeps run from the end until one of them merges nothing, and
    every sweep turns the order round.
    """
    boxes: list[tuple] = []
    for r in rects:
        if not _absorbed(boxes, r, gap):
            boxes.append(r)
    while True:
        kept: list[tuple] = []
        n = len(boxes)
        while boxes:
            r = boxes.pop()
            if not _absorbed(boxes, r, gap):
                kept.append(r)
        boxes = kept
        if len(kept) == n:
            return kept


def merge_rects(rects: DataFrame, key: list[str], gaps: tuple = LAYOUT.table_gaps) -> DataFrame:
    """key, part, x0, y0, x1, y1: boxes of each page's rectangles (in the order of seq), closed under each gap in turn."""

    def run(boxes):
        for g in gaps:
            boxes = close_rects(boxes, g)
        return [(k + 1, *b) for k, b in enumerate(boxes)]

    return per_page(_sided(rects), key, ["seq", *SIDES], list(SIDES), _one_by_one(run, 5), f"part int, {BOX}")


def _tenths(y: np.ndarray) -> np.ndarray:
    """Python's round(y, 1), which numpy's differs from near halves."""
    with np.errstate(invalid="ignore", over="ignore"):
        out, part = np.round(y, 1), np.abs(y * 10 % 1 - 0.5)
        odd = np.flatnonzero(np.isfinite(y) & ((part < 1e-3) | (np.abs(y) > 1e9)))
    out[odd] = [round(v, 1) for v in y[odd].tolist()]
    return out


def _line_of_runs(page: list[int], y: list[float], size: list[int], gap: float) -> list[int]:
    """The line that each run of spans at one height joins, the first of its page whose running mean is close.

    Lines are numbered as they begin. Heights of a page rise but for rounding and those that are no numbers come last,
    so lines far above are never met again. All spans of a run join one line, as its mean only comes closer to them.
    """
    out, live, n, on = [], [], 0, None
    for p, h, k in zip(page, y, size):
        if p != on:
            on, live = p, []
        at = next((x for x in live if abs(x[0] - h) <= gap), None)
        if at is None:
            at = [h, n]
            n += 1
            live = [x for x in live if x[0] >= h - gap - 0.2]
            live.append(at)
            k -= 1
        while k and (mean := (at[0] + h) / 2) != at[0]:
            at[0] = mean
            k -= 1
        out.append(at[1])
    return out


_BYTES = np.arange(256)
OPENING, CLOSING = np.isin(_BYTES, list(b' -"(/')), np.isin(_BYTES, list(b",.):;"))


def _spaced(texts: pa.Array, x0: np.ndarray, x1: np.ndarray, gap: float) -> np.ndarray:
    """Whether a space is due before each span, if another is before it; no text is empty."""
    offs = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)
    first, end = offs[:-1], offs[1:]
    opens = OPENING[raw[end - 1]]
    for i in np.flatnonzero((raw[end - 1] == 0x9C) & (end - first >= 3)).tolist():
        opens[i] = raw[end[i] - 3 : end[i]].tobytes() == "“".encode()
    due = np.zeros(len(texts), bool)
    due[1:] = (x0[1:] - x1[:-1] > gap) | ~(opens[:-1] | CLOSING[raw[first[1:]]])
    return due


def assemble_lines(spans: DataFrame, key: list[str], cfg: Layout = LAYOUT, together: bool = False) -> DataFrame:
    """Lines of each page: spans in reading order join the first line whose running mean height is close.

    spans: key, seq, text, x0..y1, is_bold; those without text are left out. together: as in per_page.
    """

    def run(columns, starts):
        text, *sides, bold = columns
        if sides[1].null_count:
            raise ValueError("a span with text has no y0")
        x0, y0, x1, y1 = (c.to_numpy(zero_copy_only=False) for c in sides)
        lost = [c.is_null().to_numpy(zero_copy_only=False) for c in sides]
        page = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(text)))
        order = np.lexsort((x0, _tenths(y0), page))
        p, y = page[order], y0[order]
        runs = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (y[1:] != y[:-1])]))
        size = np.diff(runs, append=len(y))
        line = np.repeat(_line_of_runs(p[runs].tolist(), y[runs].tolist(), size.tolist(), cfg.row_gap), size)
        again = np.lexsort((x0[order], line))
        order, line = order[again], line[again]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        n = np.diff(first, append=len(line))
        texts = text.cast(pa.string()).take(pa.array(order))
        due = _spaced(texts, x0[order], x1[order], cfg.word_gap)
        due[1:] &= ~lost[2][order][:-1]
        due[first] = False
        parts = pc.binary_join_element_wise(pc.if_else(pa.array(due), " ", ""), texts, "")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(line)), pa.int32()), parts), "")
        box = [f.reduceat(v[order], first) for f, v in zip((np.minimum, np.minimum, np.maximum, np.maximum), (x0, y0, x1, y1))]
        lost = [np.logical_or.reduceat(v[order], first) for v in lost]
        share = np.add.reduceat(pc.fill_null(bold, False).to_numpy(zero_copy_only=False)[order].astype(np.int64), first) / n
        at = page[order[first]]
        rank = np.lexsort((box[0], box[1], at))
        at = at[rank]
        number = np.arange(len(at)) - np.searchsorted(at, at)
        stripped = [t.strip() for t in joined.take(pa.array(rank)).to_pylist()]
        return at, [number, stripped, *(pa.array(v[rank], mask=x[rank]) for v, x in zip(box, lost)), share[rank]]

    fields = ["text", *SIDES, "is_bold"]
    return per_page(_sided(spans.where("text <> ''")), key, ["seq", *fields], fields, run, f"line_no int, text string, {BOX}, bold_share double", together)


def bold_lines(lines: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """Non-empty lines enough of whose spans are bold."""
    return lines.where((F.col("bold_share") >= cfg.bold_share) & (F.col("text") != ""))


def merge_bold(lines: DataFrame, key: list[str], cfg: Layout = LAYOUT) -> DataFrame:
    """Bold lines that continue each other become one block; each is compared with the block so far."""

    def run(rows):
        blocks: list[tuple] = []
        for y0, x0, text, x1, y1 in rows:
            box = x0, y0, x1, y1
            if blocks:
                parts, cur = blocks[-1]
                beside = abs(y0 - cur[1]) <= cfg.row_gap and x0 >= cur[0]
                below = 0 <= y0 - cur[3] <= cfg.bold_next and abs(x0 - cur[0]) <= cfg.bold_shift
                if beside or below:
                    parts.append(text)
                    blocks[-1] = parts, around(cur, box)
                    continue
            blocks.append(([text], box))
        return [(k, re.sub(r"\s{2,}", " ", " ".join(parts)).strip(), *box) for k, (parts, box) in enumerate(blocks)]

    order = ["y0", "x0", "line_no", "text", "x1", "y1"]
    return per_page(_sided(bold_lines(lines, cfg)), key, order, ["y0", "x0", "text", "x1", "y1"], _one_by_one(run, 6), f"block_no int, text string, {BOX}")


def table_pages(segments: DataFrame, key: list[str], cfg: Layout = LAYOUT) -> DataFrame:
    """key, n_h, n_v of the pages whose segments (kind, x1, y1, x2, y2) are enough, of both kinds, and span enough area."""
    low, high = (lambda d: F.min(F.least(f"{d}1", f"{d}2"))), (lambda d: F.max(F.greatest(f"{d}1", f"{d}2")))
    area = (high("x") - low("x")) * (high("y") - low("y"))
    pages = segments.where("kind in ('h', 'v')").groupBy(*key).agg(F.count_if(F.col("kind") == "h").alias("n_h"), F.count_if(F.col("kind") == "v").alias("n_v"), area.alias("__area"))
    return pages.where((F.col("n_h") >= cfg.table_horizontal) & (F.col("n_v") >= cfg.table_vertical) & (F.col("__area") >= cfg.table_area)).drop("__area")


def table_regions(segments: DataFrame, key: list[str], cfg: Layout = LAYOUT) -> DataFrame:
    """key, part, x0, y0, x1, y1: tables of the pages that pass the gate. segments: key, seq, kind, x1, y1, x2, y2.

    Horizontal segments come before vertical ones, each kind in the order of seq.
    """
    rows = segments.where("kind in ('h', 'v')").join(table_pages(segments, key, cfg), key, "left_semi")
    box = [f(f"{d}1", f"{d}2").cast("double").alias(n) for n, f, d in (("x0", F.least, "x"), ("y0", F.least, "y"), ("x1", F.greatest, "x"), ("y1", F.greatest, "y"))]
    rows = rows.select(*key, F.struct("kind", "seq").alias("seq"), *box)
    return merge_rects(rows, key, cfg.table_gaps).where(geometry.area() >= cfg.table_area)


def figure_regions(placements: DataFrame, key: list[str], cfg: Layout = LAYOUT) -> DataFrame:
    """key, part, x0, y0, x1, y1: merged image placements; those too small go before they could merge."""
    return merge_rects(placements.where(geometry.area() >= cfg.figure_area), key, (cfg.figure_gap,))


def is_chapter(c: Column) -> Column:
    """A roman numeral of at most ten letters in any case, a point, white space and text."""
    return strip(c).rlike(rf"^[IVXLCDMivxlcdmıİ]{{1,10}}\.{SPACE}+[^\n]+\z")


def question_starts(lines: DataFrame) -> DataFrame:
    """The lines that begin with one to four digits, a point and white space, with the number as num."""
    number = F.regexp_extract("text", rf"^{SPACE}*({DIGIT}{{1,4}})\.{SPACE}", 1)
    return lines.withColumn("num", F.when(number != "", number).try_cast("int")).where("num is not null")


def hinges(blocks: DataFrame, starts: DataFrame, pages: DataFrame, doc: str, page: str, cfg: Layout = LAYOUT) -> DataFrame:
    """The bold blocks that are no chapters and stand close above a question.

    The first question start at or below the block decides on its page; if it is too far or missing, a block near the
    page's end takes one near the top of the next page. pages: doc, page, page_height.
    """
    ys = starts.groupBy(doc, page).agg(F.collect_list("y0").alias("__ys"), F.min("y0").alias("__top"))
    rows = blocks.where(~is_chapter(F.col("text"))).join(pages.select(doc, page, F.col("page_height").alias("__height")), [doc, page], "left")
    rows = rows.join(ys.select(doc, page, "__ys"), [doc, page], "left").join(ys.select(doc, (F.col(page) - 1).alias(page), "__top"), [doc, page], "left")
    here = F.array_min(F.filter("__ys", lambda y: y >= F.col("y1"))) - F.col("y1") <= cfg.hinge_reach
    after = (F.col("__height") - F.col("y1") <= cfg.page_bottom) & (F.col("__top") <= cfg.page_top)
    return rows.where(F.coalesce(here, F.lit(False)) | F.coalesce(after, F.lit(False))).select(blocks.columns)
