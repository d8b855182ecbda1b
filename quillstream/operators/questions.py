"""Numbered questions in stitched text: starts, extents, formatting with tables, and their rendering.

Null and empty texts have no questions. A text is handled whole in one call, so one document must fit a task.
"""

from __future__ import annotations

import re
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TEXT

#: Tokens of signature lines, years that are no question numbers, patterns of starts and of the table of
#: parts and works, its heading, and the words that stand for its character cell.
SIGNATURE = ("firmado digitalmente", "sellodigital", "utc", "fecha:", "razón", "razon", "lugar:")
YEARS = (1900, 2100)
_START = re.compile(r"(?m)^\s*(\d{1,4})\.\s+")
_BARE = re.compile(r"^\s*\d{1,4}\.\s*$")
_LETTER = re.compile(r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]")
_PARTS = re.compile(r"(?i)^\s*Tabla\s+XX\.\s*Partes\s+y\s+obras\s+del\s+Proyecto\s*$")
_NAME = re.compile(r"(?i)^\s*\[(Nombre\s+parte/obra\s+.+?)\]\s*$")
_CHARACTER = re.compile(r"(?i)^\s*\[(Temporal\s+o\s+permanente)\]\s*$")
_PHASE = re.compile(r"(?i)^\s*\[(Construcción.*?cierre)\]\s*$")
HEADING = ("Tabla", "Nombre", "Descripción", "Carácter", "Fase")
CHARACTER = "Temporal o permanente"
_STARTER = r"(?:[A-Za-z]\)|\d+\)|\([A-Za-z0-9]+\)|[-•])"


def _wanted(text: str, at: int, digits: str) -> bool:
    """Whether a candidate at position at is a question start."""
    line_end = text.find("\n", at)
    line = text[at : line_end if line_end >= 0 else len(text)]
    year = len(digits) == 4 and YEARS[0] <= int(digits) <= YEARS[1]
    if year and any(t in line.lower() for t in SIGNATURE):
        return False
    if not _BARE.match(line):
        return True
    if year or (len(digits) >= 2 and digits[0] == "0"):
        return False
    rest = text[line_end + 1 :] if line_end >= 0 else ""
    after = next((x.strip() for x in rest.split("\n") if x.strip()), None)
    return after is None or bool(_LETTER.match(after))


def segments(text: str, drop: int = TEXT.most_drop) -> list[tuple[int, str]]:
    """(number, raw text) of each question."""
    starts, last = [], None
    for m in _START.finditer(text or ""):
        n = int(m[1])
        if not _wanted(text, m.start(), m[1]) or (last is not None and n < last and last - n >= drop):
            continue
        starts.append((n, m.start(), m.end()))
        last = n
    ends = [s for _, s, _ in starts[1:]] + [len(text or "")]
    return [(n, text[b:e].strip()) for (n, _, b), e in zip(starts, ends)]


def flowing(text: str) -> str:
    """The paragraph rule of functions.text.paragraphs on one string."""
    mark = "\x00"
    text = re.sub(r"\n\s*\n+", f"\n{mark}\n", re.sub(r"-\n(?=\w)", "", text))
    text = re.sub(r"\n+", " ", re.sub(rf"\n\s*(?={_STARTER})", f"\n{mark}\n", text))
    return re.sub(r"[ \t]{2,}", " ", text.replace(mark, "\n")).strip()


def row_cells(line: str) -> list[str]:
    """The cells of a table row; fewer than two mean that the line is none."""
    return [c.strip() for c in re.split(r"\s{2,}", line.strip()) if c.strip()]


def _is_row(line: str) -> bool:
    return len(row_cells(line)) > 1


def rows_table(lines: list[str]) -> str:
    """Rows of equally many cells, ``;`` between them."""
    rows = [row_cells(x) for x in lines]
    widest = max(map(len, rows), default=0)
    return "\n".join(";".join(r + [""] * (widest - len(r))) for r in rows)


class _Parts:
    """Reads a table of parts and works from lines[at]; ``at`` is the first line it leaves."""

    def __init__(self, lines: list[str], at: int):
        self.lines, self.at, self.rows = lines, at, []
        title = lines[at].strip()
        self.to_name()
        while (name := self.match(_NAME)) or self.match(_PARTS):
            if not name:
                self.to_name()
                continue
            self.at += 1
            about = list(takewhile(lambda x: not (_CHARACTER.match(x) or _NAME.match(x)), lines[self.at :]))
            self.at += len(about)
            character = CHARACTER if self.took(_CHARACTER) else ""
            self.rows.append((title, f"[{name[1]}]", flowing("\n".join(about)), character, self.phase()))
            self.at += len(list(takewhile(lambda x: not x.strip(), lines[self.at :])))
            if self.match(_BARE):
                break

    def match(self, pattern):
        return pattern.match(self.lines[self.at].strip()) if self.at < len(self.lines) else None

    def took(self, pattern):
        m = self.match(pattern)
        self.at += m is not None
        return m

    def to_name(self):
        """From a title on to the next name."""
        self.at += 1
        while self.at < len(self.lines) and not self.match(_NAME):
            self.at += 1

    def phase(self) -> str:
        if m := self.took(_PHASE):
            return m[1]
        cell = self.lines[self.at].strip() if self.at < len(self.lines) else ""
        if cell.startswith("[") and cell.endswith("]"):
            self.at += 1
            return cell.strip("[]").strip()
        return ""


def formatted(raw: str) -> str:
    """A question's text: tables as ``;`` rows, the text between them in paragraphs, one block under another."""
    lines = [x.rstrip("\r") for x in (raw or "").replace("\f", "\n").split("\n")]
    blocks: list[str] = []
    held: list[str] = []

    def close(table: str = ""):
        blocks.extend(b for b in (flowing("\n".join(held).strip()), table) if b)
        held.clear()

    at = 0
    while at < len(lines):
        line = lines[at]
        if _PARTS.match(line.strip()):
            close()  # whether or not rows follow
            parts = _Parts(lines, at)
            if parts.rows:
                close("\n".join(";".join(r) for r in (HEADING, *parts.rows)))
                at = parts.at
                continue
        run = list(takewhile(_is_row, lines[at:])) if _is_row(line) else []
        if run:
            close(rows_table(run))
            at += len(run)
        else:
            held.append(line if line.strip() else "")
            at += 1
    close()
    return "\n".join(blocks).strip()


def split_questions(texts: DataFrame, doc: str) -> DataFrame:
    """doc, seq, numero, texto of every question of each document's text, formatted."""

    @F.udf("array<struct<numero int, texto string>>", useArrow=True)
    def found(text):
        return [(n, formatted(x)) for n, x in segments(text)]

    return texts.select(doc, F.posexplode(found("text")).alias("seq", "q")).select(doc, "seq", "q.numero", "q.texto")


SEPARATOR = "------------"


def render(capitulo: Column, bisagra: Column, numero: Column, texto: Column, tablas_figuras: Column | None = None) -> Column:
    """The text block of one question; its tables and figures follow, one line each."""
    head = F.when(F.length(capitulo) > 0, F.concat(F.lit("CAPITULO: "), capitulo))
    hinge = F.when(F.length(bisagra) > 0, F.concat(F.lit("BISAGRA: "), bisagra))
    block = [F.lit(SEPARATOR), head, hinge, F.concat(F.lit("NUMERO: "), numero.cast("string")), texto]
    if tablas_figuras is not None:
        line = lambda t: F.concat(F.lit("  ["), F.upper(t["tipo"]), F.lit("] parte "), t["parte"].cast("string"), F.lit(": "), t["png"])
        block.append(F.transform(tablas_figuras, line))
    return F.concat_ws("\n", *block)


def rendered(questions: DataFrame, doc: str) -> DataFrame:
    """doc, text: all blocks of a document in the order of seq, and the separator at the end."""
    rows = questions.select(doc, "seq", render(F.col("capitulo"), F.col("bisagra"), F.col("numero"), F.col("texto"), F.col("tablas_figuras")).alias("__b"))
    rows = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("seq", "__b"))).alias("__b"))
    return rows.select(doc, F.concat(F.array_join(F.transform("__b", lambda x: x["__b"]), "\n"), F.lit(f"\n{SEPARATOR}\n")).alias("text"))


def format_texts(text: Column) -> Column:
    """formatted() as a column; null gives an empty string."""
    return F.udf(formatted, "string", useArrow=True)(text)
