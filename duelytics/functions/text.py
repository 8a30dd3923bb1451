"""Text normalization, keyword patterns and transcripts as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from duelytics.constants import CULTURAL_STEMS, WHITESPACE

#: One word character: letters, numbers of every script, underscore.
WORD = r"[\p{L}\p{N}_]"


def clean_text(x: Column) -> Column:
    """Strip and lower-case; blank text becomes null."""
    return F.nullif(F.lower(F.btrim(x, F.lit(WHITESPACE))), F.lit(""))


def conversation_text(messages: Column) -> Column:
    """All message contents joined by a space, lower-cased; null gives an empty text."""
    contents = F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("")))
    return F.coalesce(F.lower(F.array_join(contents, " ")), F.lit(""))


def quote(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def boundaries(keyword: str, letters: str = "") -> tuple[str, str]:
    """What must stand in front of a keyword, also seen from behind its `letters`, and what behind it."""
    is_word = [re.match(r"\w", c) for c in (keyword[0], keyword[-1])]
    return f"(?<{'!' if is_word[0] else '='}{WORD}{letters})", f"(?{'!' if is_word[1] else '='}{WORD})"


def found_keyword_pattern(keyword: str) -> str:
    """One whole keyword: its letters are looked for first, which is fast, and what is around them then."""
    before, after = boundaries(keyword, quote(keyword))
    return quote(keyword) + before + after


def keyword_pattern(keywords: Iterable[str]) -> str:
    """One pattern for a category: whole keywords, longest first.

    The word boundaries are lookarounds on `WORD`, so they treat accented letters alike on
    every Java version.
    """

    ordered = sorted(keywords, key=len, reverse=True)
    plain = all(re.fullmatch(r"\w(.*\w)?", k, re.DOTALL) for k in ordered)
    if plain:
        return f"(?<!{WORD})(?:" + "|".join(quote(k) for k in ordered) + f")(?!{WORD})"
    return "|".join(before + quote(k) + after for k in ordered for before, after in [boundaries(k)])


def stem_pattern(stems: Sequence[str] = CULTURAL_STEMS) -> str:
    return "(?iu)(" + "|".join(stems) + ")"


def mentions(values: Column, pattern: str) -> Column:
    """True when the joined array matches the pattern; null arrays do not."""
    return F.rlike(F.coalesce(F.array_join(values, " "), F.lit("")), F.lit(pattern))


MESSAGE = "struct<role:string,content:string>"


def parse_transcript(raw: Column) -> Column:
    """A transcript kept as text → array of {role, content}.

    Single quotes are read as double quotes.  Anything but one complete list gives an empty array,
    items that are not objects are skipped, a missing field is an empty string.
    """
    fixed = F.replace(raw, F.lit("'"), F.lit('"'))
    # The parser stops behind the first value; inside an object anything that follows is an error.
    whole = F.try_parse_json(F.concat(F.lit('{"a":['), fixed, F.lit("]}")))
    single = F.size(F.try_variant_get(whole, "$.a", "array<variant>")) == 1
    items = F.when(single, F.try_variant_get(whole, "$.a[0]", "array<variant>"))
    objects = F.filter(items, lambda item: F.schema_of_variant(item).startswith("OBJECT"))
    parsed = F.transform(
        objects,
        lambda item: F.struct(
            F.try_variant_get(item, "$.role", "string").alias("role"),
            F.try_variant_get(item, "$.content", "string").alias("content"),
        ),
    )
    return F.coalesce(native_transcript(parsed), F.array().cast(f"array<{MESSAGE}>"))


def native_transcript(messages: Column) -> Column:
    """Messages with empty strings instead of missing roles or contents."""

    def filled(m: Column) -> Column:
        return F.struct(
            F.coalesce(m["role"], F.lit("")).alias("role"),
            F.coalesce(m["content"], F.lit("")).alias("content"),
        )

    present = F.filter(messages, lambda m: m.isNotNull())
    return F.coalesce(F.transform(present, filled), F.array().cast(f"array<{MESSAGE}>"))
