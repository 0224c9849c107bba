"""Column -> Column text operators (no UDFs; usable in batch and Structured Streaming).

Python's ``re`` classes are Unicode-aware while Java's ``\\s \\w \\S`` are ASCII, so
the classes below are spelled out explicitly. The same pattern strings are valid
for Java regex (Spark) and RE2 (the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes equal to Python's Unicode ``\s`` and ``\w``.
SPACE_CLASS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WORD_CLASS = r"\p{L}\p{N}_"

# The cleaning patterns, applied in this order after lower-casing.
URL_PATTERN = rf"https?://[^{SPACE_CLASS}]+|www\.[^{SPACE_CLASS}]+"
MENTION_PATTERN = rf"@[{WORD_CLASS}]+"
HASHTAG_PATTERN = rf"#([{WORD_CLASS}]+)"
SYMBOL_OTHER_PATTERN = r"[\p{S}\p{C}]"
SPACE_RUN_PATTERN = rf"[{SPACE_CLASS}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_urls(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), URL_PATTERN, "")


def strip_mentions(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), MENTION_PATTERN, "")


def unwrap_hashtags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), HASHTAG_PATTERN, "$1")


def drop_symbols_and_controls(c: Column | str) -> Column:
    """Delete characters of Unicode category S* or C* (emoji, ``$``, newlines, tabs)."""
    return F.regexp_replace(_col(c), SYMBOL_OTHER_PATTERN, "")


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), SPACE_RUN_PATTERN, " "))


def _where_found(value: Column, body, *needles: str) -> Column:
    """``body`` of the texts that hold one of ``needles``, which its pattern needs; the others are spared
    the pattern. The value is computed once, as the one element of an array."""
    def one(x: Column) -> Column:
        found = F.contains(x, F.lit(needles[0]))
        for n in needles[1:]:
            found = found | F.contains(x, F.lit(n))
        return F.when(found, body(x)).otherwise(x)
    return F.transform(F.array(value), one)[0]


def clean_text(c: Column | str, newline_to_space: bool = False) -> Column:
    """Composite cleaner: null -> '', lower, URLs, mentions, hashtags, S/C chars, spaces.

    ``newline_to_space=True`` turns whitespace controls into spaces before the
    category filter instead of gluing the neighbouring words together.
    """
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    t = _where_found(t, strip_urls, "http", "www.")
    t = _where_found(t, strip_mentions, "@")
    t = _where_found(t, unwrap_hashtags, "#")
    if newline_to_space:
        t = F.regexp_replace(t, SPACE_RUN_PATTERN, " ")
    t = drop_symbols_and_controls(t)
    return collapse_spaces(t)


def char_split_point(c: Column | str, fraction: float = 0.5) -> Column:
    """``int(len(text) * fraction)`` in characters (code points)."""
    return F.floor(F.length(_col(c)) * F.lit(float(fraction))).cast("int")


def char_prompt(c: Column | str, fraction: float = 0.5) -> Column:
    """First ``int(len*fraction)`` characters."""
    col = _col(c)
    return F.substr(col, F.lit(1), char_split_point(col, fraction))


def char_reference(c: Column | str, fraction: float = 0.5) -> Column:
    """Everything after the prompt."""
    col = _col(c)
    return F.substr(col, char_split_point(col, fraction) + F.lit(1))


def strip_prefix(full: Column | str, prefix: Column | str) -> Column:
    """``full[len(prefix):].strip()`` -- continuation only, trimmed."""
    return F.trim(F.substr(_col(full), F.length(_col(prefix)) + F.lit(1)))
