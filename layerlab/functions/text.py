"""Text expressions: cleaning, emoticons, emoji, tokens.

All functions map Column -> Column and stay inside the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerlab.functions.fixed_values import (
    BLANKS,
    EMOTICONS,
    WORD_PATTERN,
)


def lower_text(text: Column) -> Column:
    """Lower-cased text, '' for null."""
    return F.lower(F.coalesce(text, F.lit("")))


def replace_emoticons(text: Column, table: dict[str, str] = EMOTICONS) -> Column:
    """Literal replacements in table order.

    The order is part of the contract (`:)` fires before `:))`). Texts without
    any of the keys' first characters skip the chain: replacements are words,
    so they can never bring such a character in.
    """
    first = sorted({key[0] for key in table})
    present = reduce(lambda a, b: a | b, [F.contains(text, F.lit(ch)) for ch in first])
    replaced = reduce(
        lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), table.items(), text
    )
    return F.when(present, replaced).otherwise(text)


def emoji_names_by_rule() -> dict[str, str]:
    """Symbol -> snake_case name from the Unicode character database."""
    blocks = [(0x2600, 0x27BF), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1FAFF)]
    names = {}
    for lo, hi in blocks:
        for code in range(lo, hi + 1):
            name = unicodedata.name(chr(code), "")
            if name:
                names[chr(code)] = re.sub(r"[^a-z0-9]+", "_", name.lower())
    return names


def _ranges(codes: set[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for code in sorted(codes):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return [(a, b) for a, b in out]


def _gaps(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    gaps, start = [], 0
    for lo, hi in sorted(ranges):
        if lo > start:
            gaps.append((start, lo - 1))
        start = hi + 1
    return [*gaps, (start, 0x10FFFF)]


def _char_class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def emoji_to_name(text: Column, names: dict[str, str], separate: bool = False) -> Column:
    """Replace each symbol by `:name:`, longest key first; other text is kept.

    Texts without a character in the symbols' code range are passed through.
    `separate=True` puts blanks round each name, so that neighbours stay apart
    when a cleaner drops the colons.
    """
    heads = _ranges({ord(k[0]) for k in names})
    head = _char_class(heads)
    long_keys = sorted((k for k in names if len(k) > 1), key=lambda k: (-len(k), k))
    parts = [_char_class(_gaps(heads)) + "+", *[re.escape(k) for k in long_keys], head]
    pieces = F.regexp_extract_all(text, F.lit(f"({'|'.join(parts)})"))
    blank = " " if separate else ""
    lookup = F.create_map(
        *[F.lit(x) for k, v in sorted(names.items()) for x in (k, f"{blank}:{v}:{blank}")]
    )
    named = F.transform(
        pieces,
        lambda p: F.when(p.rlike("^" + head), F.coalesce(F.element_at(lookup, p), p)).otherwise(p),
    )
    around = _char_class([(heads[0][0], heads[-1][1])])
    return F.when(text.rlike(around), F.array_join(named, "")).otherwise(text)


def outside_class(keep: str) -> str:
    """Regex class of every character but a-z, A-Z, 0-9, blanks and `keep`.

    Blanks are Unicode white space and the four separators U+001C to U+001F.
    """
    return rf"(?U)[^a-zA-Z0-9\s\x1c-\x1f{re.escape(keep)}]"


def _clean(
    text: Column, keep: str, table: dict[str, str], emoji: dict[str, str] | None, separate: bool
) -> Column:
    out = replace_emoticons(lower_text(text), table)
    if emoji:
        out = emoji_to_name(out, emoji, separate)
    out = F.regexp_replace(out, outside_class(keep) + "+", "")
    return F.trim(F.regexp_replace(out, f"[{BLANKS}]+", " "))


def clean_text_keep_punct(
    text: Column,
    table: dict[str, str] = EMOTICONS,
    emoji: dict[str, str] | None = None,
    separate: bool = False,
) -> Column:
    """Lower, emoticons, emoji names; keep letters, digits, blanks and . , ! ?"""
    return _clean(text, ".,!?", table, emoji, separate)


def clean_text_alnum(
    text: Column,
    table: dict[str, str] = EMOTICONS,
    emoji: dict[str, str] | None = None,
    separate: bool = False,
) -> Column:
    """Lower, emoticons, emoji names; keep letters, digits and blanks."""
    return _clean(text, "", table, emoji, separate)


def tokenize_words(text: Column) -> Column:
    """Lower-case runs of two or more word characters (any script)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN))


def remove_stop_words(tokens: Column, stop_words: list[str]) -> Column:
    """Drop the listed tokens, keep order and repeats."""
    return F.filter(tokens, lambda t: ~t.isin(stop_words))
