"""Text columns: strip, fold, gap markers, tokens, literal matching, highlights."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.settings import SNIPPET_CHARS, SNIPPET_LEAD

# Whitespace as Python's str.strip and str.split see it.
SPACE = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]"
NOT_SPACE = r"[^\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]"
# The gap marker and the word pattern.
GAP = r"(?iu)\[ileg[ií]vel\]"
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)?"
# Letters that match with or without an accent when a hit is marked.
ACCENTED = {
    "a": "aáàâãä",
    "e": "eéèêë",
    "i": "iíìîï",
    "o": "oóòôõö",
    "u": "uúùûü",
    "c": "cç",
    "n": "nñ",
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed a single time per row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without whitespace at the ends; the pattern runs only where an end has some."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(SPACE), F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")).otherwise(text)


def has_text(text: Column) -> Column:
    """True when something other than whitespace is there; null counts as nothing."""
    return F.coalesce(text.rlike(NOT_SPACE), F.lit(False))


def squeeze(text: Column) -> Column:
    """Whitespace runs become one space, ends are stripped."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    source, target = [], []
    for code in range(0xA0, 0x10000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        bases = [c for c in unicodedata.normalize("NFD", char) if not unicodedata.category(c).startswith("M")]
        if len(bases) == 1 and bases[0] != char:
            source.append(char)
            target.append(bases[0])
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents: composed letters by table, loose marks by pattern."""
    source, target = _fold_table()
    plain = F.octet_length(text) == F.char_length(text)  # ASCII, which has neither
    return F.lower(F.when(plain, text).otherwise(F.regexp_replace(F.translate(text, source, target), r"\p{M}+", "")))


def fold_query(query: str) -> str:
    """The same fold for a query string on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.strip()) if not unicodedata.category(c).startswith("M"))
    return plain.lower()


def query_words(query: str) -> list[str]:
    return [word for word in fold_query(query).split() if len(word) >= 2]


def text_match(text: Column, query: str) -> Column:
    """The folded phrase, or each of two or more words, occurs in the folded text."""
    phrase = fold_query(query)
    if len(phrase) < 2:
        return F.lit(False)
    words = query_words(query)

    def matched(folded: Column) -> Column:
        found = folded.contains(phrase)
        if len(words) > 1:
            every = folded.contains(words[0])
            for word in words[1:]:
                every = every & folded.contains(word)
            found = found | every
        return found

    return F.coalesce(once(fold(strip(text)), matched), F.lit(False))


def name_match(filename: Column, query: str) -> Column:
    phrase = fold_query(query)
    return F.lit(True) if not phrase else fold(filename).contains(phrase)


def has_gap(text: Column) -> Column:
    return F.coalesce(text.rlike(GAP), F.lit(False))


def gap_query(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def mark_pattern(query: str) -> str | None:
    """Pattern that finds the words of a query in unfolded text."""
    words = query_words(query)
    if not words:
        return None
    return "(?iu)" + "|".join(
        "".join(f"[{ACCENTED[c]}]" if c in ACCENTED else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", c) for c in word)
        for word in words
    )


def highlight(text: Column, query: str, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    pattern = mark_pattern(query)
    return text if pattern is None else F.regexp_replace(text, pattern, f"{opening}$0{closing}")


def highlight_spans(text: Column, query: str) -> Column:
    """Hit and non-hit spans in order; joined, they give the text back."""
    pattern = mark_pattern(query)
    if pattern is None:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    misses = F.split(text, pattern)
    hits = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    pairs = F.flatten(F.zip_with(misses, hits, lambda miss, hit: F.array(
        F.struct(miss.alias("text"), F.lit(False).alias("hit")),
        F.struct(hit.alias("text"), F.lit(True).alias("hit")),
    )))
    empty = F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    spans = F.filter(pairs, lambda span: span["text"] != "")
    return once(spans, lambda found: F.when(F.size(found) > 0, found).otherwise(empty))


def snippet(text: Column, query: str) -> Column:
    """At most 180 characters around the first hit."""
    pattern = mark_pattern(query)
    size = F.length(text)
    head = F.concat(strip(F.substring(text, 1, SNIPPET_CHARS)), F.lit("…"))
    if pattern is None:
        return F.when(size <= SNIPPET_CHARS, text).otherwise(head)
    # What precedes the first hit; the whole text when there is none.
    lead = F.length(F.split(text, pattern, 2)[0])
    start = F.greatest(F.lit(0), lead - SNIPPET_LEAD)
    window = strip(F.substring(text, start + 1, F.lit(SNIPPET_CHARS)))
    around = F.concat(
        F.when(start > 0, "…").otherwise(""),
        window,
        F.when(start + SNIPPET_CHARS < size, "…").otherwise(""),
    )
    return F.when(size <= SNIPPET_CHARS, text).when(text.rlike(pattern), around).otherwise(head)
