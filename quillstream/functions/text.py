"""Text columns with Python's notion of white space, digits and word characters. Null texts give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters one by one: trimming by a set looks at the ends only, a pattern would try every place.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use() names it."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def normalize(c: Column) -> Column:
    """Lower case, outer white space gone, inner runs one space; null gives an empty string."""
    # Single spaces, the most frequent case, match nothing and are not copied one by one.
    other = SPACE.replace(r"\x{1C}-\x{20}", r"\x{1C}-\x{1F}")
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), f"{other}{SPACE}*| {SPACE}+", " ")), F.lit(""))


def fold(c: Column) -> Column:
    """normalize() without the accents of Spanish letters."""
    return F.translate(normalize(c), "áéíóúüñ", "aeiouun")


def as_words(c: Column) -> Column:
    """A text whose words stand between single spaces, for whole-word tests by contains()."""
    return F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}_ ][^\p{L}\p{N}_]*| [^\p{L}\p{N}_]+", " "), F.lit(" "))


def paragraphs(c: Column) -> Column:
    """Joins hyphenated and broken lines; blank lines and list starters keep a line break between spaces."""
    mark, run = "\x00", SPACE
    c = F.regexp_replace(c, rf"-\n(?={WORD})", "")
    c = F.regexp_replace(c, rf"\n{run}*\n+", f"\n{mark}\n")
    c = F.regexp_replace(c, rf"\n{run}*(?=[A-Za-z]\)|{DIGIT}+\)|\([A-Za-z0-9]+\)|[-•])", f"\n{mark}\n")
    c = F.replace(F.regexp_replace(c, r"\n+", " "), F.lit(mark), F.lit("\n"))
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


#: Patterns of signature blocks and of the date above them.
STAMP = r"(?iu)(?:Fecha:\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s+\d{1,2}:\d{2}[:\d.]*\s*(?:UTC\s*[+-]?\d{2}:\d{2})?\s*(?:Lugar:\s*)?)+"
SIGNED = r"(?iu)Firmado\s+Digitalmente\s+por\s+[^\n]+"
DATED = r"(?iu)\d{1,2}\s+de\s+[\p{L}\p{N}_]+\s+de\s+\d{4}\.\s*\z"


def _python(pattern: str) -> str:
    """The pattern with Python's classes of white space and digits."""
    return pattern.replace(r"[:\d.]", rf"[:{DIGIT}.]").replace(r"\s", SPACE).replace(r"\d", DIGIT)


def without_signature(c: Column) -> Column:
    """Removes time stamps, digital-signature runs to the line's end, then a trailing long date; the left end stays."""
    c = F.regexp_replace(F.regexp_replace(c, _python(STAMP), ""), _python(SIGNED), "")
    return rstrip(F.regexp_replace(rstrip(c), _python(DATED), ""))


def without_trailing(c: Column, hinges: Column) -> Column:
    """Removes the first of hinges that the right-stripped text ends with, once; its final point may be missing.

    Null or no hinges and blank ones remove nothing. Of each hinge the whole form is tried before the shortened one.
    """
    forms = F.flatten(F.transform(F.filter(F.transform(hinges, strip), lambda h: h != ""), lambda h: F.array(h, F.regexp_replace(h, r"\.\z", ""))))

    def cut(t):
        fits = F.filter(forms, lambda h: (h != "") & F.endswith(t, h))
        return let(F.get(fits, F.lit(0)), lambda h: rstrip(F.when(h.isNull(), t).otherwise(F.substring(t, F.lit(1), F.length(t) - F.length(h)))))

    return let(rstrip(c), cut)


def is_table_row(c: Column) -> Column:
    """At least two non-blank cells between runs of two or more white spaces."""
    return F.size(cells(c)) >= 2


def cells(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), f"{SPACE}{{2,}}"), strip), lambda x: x != "")


def listed(c: Column) -> Column:
    """The trimmed, non-empty items of a comma-separated list."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
