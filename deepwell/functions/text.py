"""Text functions. All are JVM-side column expressions, so scans stay in whole-stage pipelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts written without spaces between words, as the inside of a Java character class.
UNSPACED = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\uAC00-\\uD7AF\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF"
_RUN = f"[{UNSPACED}]+|[\\p{{IsAlphabetic}}\\p{{N}}&&[^{UNSPACED}]]+"
_SPACED_RUN = "[\\p{IsAlphabetic}\\p{N}]+"
_GAP = "[^\\p{IsAlphabetic}\\p{N}]+"
_WORD = "(?U)[^\\s\\x1c-\\x1f]+"
_SPACE = "(?U)[\\s\\x1c-\\x1f]+"

#: Sentence ends of scripts without letter case; no white space need follow them.
CASELESS_ENDS = "。．！？｡।॥։።។၊။"
_SENTENCE_GAP = f"(?U)(?<=[.!?…])\\s+|(?<=[{CASELESS_ENDS}])\\s*|(?<=[؟۔])\\s+"


def _lower(run: Column) -> Column:
    """Per character: Java turns a final capital sigma of a string into another letter."""
    return F.when(run.contains("Σ"), F.array_join(F.transform(F.split(run, ""), F.lower), "")).otherwise(F.lower(run))


def tokenize(text: Column, lowercase: bool = True) -> Column:
    """Runs of letters and digits; overlapping pairs of characters in unspaced scripts (a lone one stays)."""
    fold = _lower if lowercase else (lambda run: run)

    def parts(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{UNSPACED}]"), F.when(F.length(run) == 1, F.array(run)).otherwise(pairs)).otherwise(F.array(fold(run)))

    mixed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), parts))
    spaced = F.transform(F.regexp_extract_all(text, F.lit(_SPACED_RUN), F.lit(0)), fold)
    careful = F.when(text.rlike(f"[{UNSPACED}]"), mixed).otherwise(spaced)
    if not lowercase:
        return careful
    # without the letters whose lower case depends on neighbours or is two characters, all in compiled code
    return F.when(text.rlike(f"[{UNSPACED}Σİ]"), careful).otherwise(F.array_remove(F.split(F.lower(text), _GAP), ""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD))


def estimate_tokens(text: Column) -> Column:
    """0 for an empty text, else at least 1: words and characters weighed, unspaced characters counted apart."""
    rest = F.regexp_replace(text, f"[{UNSPACED}]", "")
    apart = (F.length(text) - F.length(rest)).cast("double")
    blend = F.lit(0.6) * count_words(rest) + F.lit(0.4) * (F.length(rest) / F.lit(4.0))
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.when(apart > 0, apart * 0.7 + blend).otherwise(blend)).cast("int")))


def collapse(text: Column) -> Column:
    """White space at the ends goes, any inside is one blank."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def query_key(text: Column) -> Column:
    """Under which queries count as the same."""
    return F.lower(collapse(text))


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(text, _SENTENCE_GAP), lambda s: F.length(collapse(s)) > 0)


def heading(block: Column) -> Column:
    """struct(level INT, title STRING) of a block that begins with a Markdown heading, null otherwise."""
    first = F.element_at(F.split(F.trim(F.regexp_replace(block, "^\\s+", "")), "\\R"), 1)
    marks = F.regexp_extract(first, "^(#{1,6})\\s+(.*)$", 1)
    title = F.trim(F.regexp_extract(first, "^(#{1,6})\\s+(.*)$", 2))
    return F.when(marks != "", F.struct(F.length(marks).alias("level"), title.alias("title")))


def citation_markers(text: Column) -> Column:
    """The numbers n of ``[n]`` markers, in order of their first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("\\[([0-9]+)\\]"), F.lit(1)), lambda n: n.cast("int")))


def sanitize_citations(text: Column, count: Column) -> Column:
    """Markers outside 1..count go; blanks are squeezed only where something went."""
    wrong = F.filter(citation_markers(text), lambda n: (n < 1) | (n > count))
    gone = F.aggregate(wrong, text, lambda t, n: F.replace(t, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(gone, " +([.,;:!?])", "$1"), "  +", " "))
    return F.when(F.size(wrong) > 0, tidy).otherwise(text)


def without_markers(text: Column) -> Column:
    """A claim as a hypothesis: no markers, no blank left before punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\[[0-9]+\\]", ""), "\\s+([.,;:!?])", "$1"))


def occurrences(text: Column, quote: Column) -> Column:
    """How often ``quote`` occurs, without overlaps; 0 for an empty quote."""
    n = (F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)
    return F.when(F.length(quote) > 0, n.cast("int")).otherwise(F.lit(0))


def content_id(text: Column) -> Column:
    """16 hexadecimal digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets given as arrays; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))
