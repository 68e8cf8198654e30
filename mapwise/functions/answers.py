"""Expressions over model answers: JSON with defaults, line scan, think blocks, repair."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

THINK_END = "</think>"


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_column(text: Column) -> Column:
    """``strip`` of a plain column, which is named several times here: a trim does what the pattern does at less cost.

    Only before a line end at the very end that is not white space itself does the pattern's ``$`` match, too.
    """
    odd = text.endswith("\u0085") | text.endswith("\u2028") | text.endswith("\u2029")
    return F.when(odd, strip(text)).otherwise(F.btrim(text, F.lit(" \t\n\x0b\f\r")))


def variant_field(parsed: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(parsed, path, kind)


def variant_kind(parsed: Column) -> Column:
    """STRING, OBJECT<..>, ARRAY<..>, ... of a parsed value."""
    return F.schema_of_variant(parsed)


def generated_text(parsed: Column) -> Column:
    """Text of an answer object or of the first object of a list; null when there is none."""
    own = variant_field(parsed, "$.generated_text", "variant")
    first = variant_field(parsed, "$[0].generated_text", "variant")
    value = F.coalesce(own, first)
    return F.when(variant_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def after_think(text: Column) -> Column:
    """What follows the first closing think tag, or everything when there is none."""
    at = F.instr(text, THINK_END)
    return strip(F.when(at > 0, F.substr(text, at + len(THINK_END))).otherwise(text))


def scanned(text: Column, key: str) -> Column:
    """Value of the last line ``key: value`` in free text; null when no line has the key."""
    found = F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*{key}:(.*)$"), F.lit(1))
    return strip(F.element_at(F.when(F.size(found) > 0, found), -1))


def repaired(text: Column) -> Column:
    """A cut answer made parseable: an odd quote is closed, a missing closing brace added."""
    quotes = F.regexp_count(text, F.lit('"'))
    closed = F.when(quotes % 2 != 0, F.concat(text, F.lit('"'))).otherwise(text)
    return F.when(closed.startswith("{") & ~closed.endswith("}"), F.concat(closed, F.lit("}"))).otherwise(closed)
