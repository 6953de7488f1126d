"""Text columns: trimming, cutting, cleaning, tokens and query phrases."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_CHARS = 300
TOOL_OUTPUT_CHARS = 4096
READ_OUTPUT_CHARS = 16384
EMBED_CHARS = 6000
CUT_MARK = "...[truncated]"
#: Unicode white space. Code points.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Query tokens: letters, decimal digits, low line.
WORD = r"[\p{L}\p{Nd}_]+"
#: Index tokens: letters, numbers of any sort, private use.
TERM = r"[\p{L}\p{N}\p{Co}]+"
#: Combining marks that vanish inside a term; any other mark ends it. Code points.
DROPPED_MARKS = "".join(map(chr, (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331)))


def trim_space(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def head(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def snippet(text: Column, n: int = SNIPPET_CHARS) -> Column:
    """The text if it has at most n code points, else the first n and three dots; nothing for n <= 0."""
    if n <= 0:
        return F.lit("")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(head(text, n), F.lit("...")))


def cut(text: Column, n: int = READ_OUTPUT_CHARS) -> Column:
    """The first n code points with a mark, if there are more; all for n <= 0."""
    if n <= 0:
        return text
    return F.when(F.length(text) <= n, text).otherwise(F.concat(head(text, n), F.lit(CUT_MARK)))


def clean(text: Column) -> Column:
    """Valid UTF-8 without control characters but tab, line feed and carriage return."""
    return F.regexp_replace(F.make_valid_utf8(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


@lru_cache(maxsize=1)
def plain_letters() -> tuple[str, str]:
    """Latin letters with one mark, and what they fold to: those that decompose to an ASCII letter and one mark."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            base = chr(int(parts[0], 16))
            if base.isascii() and chr(code).islower():
                source.append(chr(code))
                target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics; Cyrillic and Greek letters keep theirs, and final sigma is sigma."""
    source, target = plain_letters()
    # Characters beyond the length of the replacement vanish.
    return F.translate(F.lower(text), source + "ς" + DROPPED_MARKS, target + "σ")


def words(text: Column) -> Column:
    """Query tokens in order, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def terms(text: Column) -> Column:
    """Index terms in order, folded."""
    return F.regexp_extract_all(fold(text), F.lit(f"({TERM})"), F.lit(1))


def is_letter_or_digit(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind == "Nd" or c == "_"


def query_words(text: str) -> list[str]:
    out, run = [], []
    for c in text.lower():
        if is_letter_or_digit(c):
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return [*out, *(["".join(run)] if run else [])]


def fold_word(word: str) -> str:
    source, target = plain_letters()
    table = str.maketrans(source + "ς", target + "σ", DROPPED_MARKS)
    return word.lower().translate(table)


def phrase(word: str) -> list[str]:
    """The index terms of one query word; none, if it only holds separators."""
    out, run = [], []
    for c in fold_word(word):
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Co":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return [*out, *(["".join(run)] if run else [])]


def match_expression(text: str, word=lambda w: w) -> str:
    """The query as quoted words joined by AND (the form that a full-text engine takes); empty without words."""
    return " AND ".join('"' + word(w).replace('"', '""') + '"' for w in query_words(text))


def phrases(text: str, word=lambda w: w) -> list[list[str]]:
    """The query as phrases of index terms; repeated words stay repeated."""
    return [phrase(word(w)) for w in query_words(text)]


def blank(text: str | None) -> bool:
    return not text or not re.sub(r"\s+", "", text)
