"""Scalar text functions: columns in, columns out, no UDFs. Patterns are fixed values of the data model."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TOKEN = r"[a-z0-9]+(?:[./][a-z0-9]+)*"
#: The edges of words of ASCII letters, digits and _, as SQL's \b has them: Java's takes letters such as é for part of a word.
WORD = "[0-9A-Za-z_]"
BEGIN, END = f"(?-iu:(?<!{WORD})(?={WORD}))", f"(?-iu:(?<={WORD})(?!{WORD}))"
EDGE = f"(?:{BEGIN}|{END})"
SIZE = rf"{BEGIN}(\d+(?:\.\d+)?)\s*(tb|gb|mb|kb|kib|mib|gib|tib|ns|µs|us|ms){END}"
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z(\[])"
PAGE_NUMBER = r"(?i)^\s*(\d+\s*/\s*\d+|\d+|Page\s+\d+(\s+of\s+\d+)?)\s*$"
CAPTION = r"^(Table|Figure|Fig\.)\s*\d+\s*[:.]?\s+[A-Z]"
FRAGMENT = r"^[\[\(]?\d+[\]\)]?[.:]?$"
SECTION = r"^(\d+(\.\d+){0,3}\.?)\s+[A-Z]|^([IVXLC]+)\.\s+[A-Z]|^([A-Z])\.\s+[A-Z]|^§\s*\d|^(?i:Abstract|References|Acknowledg(?:e)?ments?|Conclusions?)\s*$"
NUMBER_ONLY = r"^(\d+(?:\.\d+)*\.?|[IVXLC]+\.?)$"
TIDY = [(r"\(\s+", "("), (r"\s+\)", ")"), (r"(?<!/)\s+\(", "("), (r"\s*=\s*", " = "), (r"\s+", " ")]
NUMBER_PREFIX = r"^(\d+(?:\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.|§\s*\d+(?:\.\d+)*)\s*"
MATH_FONT = r"(?i)math|cmmi|cmsy|cmex|cmbsy|msam|msbm|stix|asana|lm[a-z]{2}\d|xits"
CID = r"\(cid:\d+\)"
MISENCODED = r"\d\s*[\x{1D400}-\x{1D7FF}]{1,4}"
BROKEN = rf"(?iu){BEGIN}\d+(?:\s+\.\s*\d+|\.\s+\d+)\s*(?:ns|µs|us|ms|GB/s|MB/s|TiB|GiB|MiB|KiB|TB|GB|MB|KB|%){EDGE}"


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def collapse_units(lowered: Column) -> Column:
    """`2 mb` to `2mb` in text that is lower-cased already."""
    return F.regexp_replace(lowered, SIZE, "$1$2")


def tokens(c: Column) -> Column:
    """Distinct search tokens of the text and of its unit-collapsed form, in order of first sight."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_distinct(F.concat(extract_all(low, TOKEN), extract_all(collapse_units(low), TOKEN)))


def plain_tokens(c: Column) -> Column:
    return extract_all(F.lower(F.coalesce(c, F.lit(""))), "[a-z0-9]+")


#: Letterlike symbols that stand for letters which the block of mathematical letters leaves out.
LETTERLIKE = {0x210E: "h", 0x2102: "C", 0x210D: "H", 0x2115: "N", 0x2119: "P", 0x211A: "Q", 0x211D: "R", 0x2124: "Z", 0x212C: "B", 0x2130: "E", 0x2131: "F", 0x210B: "H", 0x2110: "I", 0x2112: "L", 0x2133: "M", 0x211B: "R"}
_DIGITS = "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split()


def _plain_letter(c: str) -> str:
    """What a mathematical letter's name ends in, as a plain letter or digit. Variant symbols, nabla and the two signs that Unicode
    names LAMDA stay as they are."""
    _, *name = unicodedata.name(c, "none").split()
    case = {"SMALL", "CAPITAL"}.intersection(name)
    if "DIGIT" in name:
        return str(_DIGITS.index(name[-1]))
    if not case or name[-1] == "LAMDA":
        return c
    if len(name[-1]) == 1:
        return name[-1] if "CAPITAL" in case else name[-1].lower()
    try:
        return unicodedata.lookup(f"GREEK {case.pop()} LETTER {name[-1]}")
    except KeyError:
        return c


def _math_pairs() -> tuple[str, str]:
    """Mathematical letters and digits, and what they stand for, for one translate()."""
    pairs = {chr(i): _plain_letter(chr(i)) for i in range(0x1D400, 0x1D800)} | {chr(i): x for i, x in LETTERLIKE.items()}
    changed = {a: b for a, b in pairs.items() if a != b}
    return "".join(changed), "".join(changed.values())


MATH_FROM, MATH_TO = _math_pairs()


def normalize_math(c: Column) -> Column:
    return F.translate(c, MATH_FROM, MATH_TO)


def band_key(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\d+", "#")


def tidy_formula(c: Column) -> Column:
    for pattern, to in TIDY:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def dehyphen_join(words: Column) -> Column:
    """Joins by spaces, but for words after one that ends in a hyphen, which stays."""
    return F.aggregate(words, F.lit(""), lambda a, w: F.when(a == "", w).when(a.endswith("-"), F.concat(a, w)).otherwise(F.concat(a, F.lit(" "), w)))


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER)


def is_caption(c: Column) -> Column:
    return c.rlike(CAPTION)


def is_fragment(c: Column) -> Column:
    return c.rlike(FRAGMENT)


def is_heading(c: Column) -> Column:
    """A short label after a number or one of the usual words: no date, no clause, no list, nine words at most after the number."""
    rest = F.trim(F.regexp_replace(c, NUMBER_PREFIX, ""))
    label = ~rest.rlike(r"[.:]\s+\S") & ~rest.contains(",") & ~rest.endswith(";") & (F.size(F.split(rest, r"\s+")) <= 9)
    return c.rlike(SECTION) & (F.length(c) <= 80) & ~c.rlike(r"^(19|20)\d{2}[.\s]") & label


def is_math_span(font: Column, text: Column) -> Column:
    return F.coalesce(font.rlike(MATH_FONT), F.lit(False)) | text.rlike(r"[\x{1D400}-\x{1D7FF}]")


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER_ONLY)


def looks_like_heading(c: Column, big: Column) -> Column:
    """A heading by its words, or a short large line that no comma, semicolon or full stop ends."""
    return is_heading(c) | (big & F.length(c).between(1, 80) & (F.size(F.split(F.trim(c), r"\s+")) <= 9) & ~c.rlike("[,;.]$"))


def alnum_ratio(c: Column) -> Column:
    dense = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(dense > 0, F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / dense)


def normalize_span(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def quote_key(c: Column) -> Column:
    folded = F.translate(F.lower(c), "µμ×–—−", "uux---")
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def without_citations(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\[\d+\]\s*", ""))


def page_range(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("p"), start.cast("string"))).otherwise(F.concat(F.lit("p"), start.cast("string"), F.lit("-"), end.cast("string")))


def preview(c: Column, width: int) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))).otherwise(flat)


def compose_query(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE)
