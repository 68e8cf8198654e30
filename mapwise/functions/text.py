"""Line tests shared by the extractors."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from mapwise.functions import vocabulary as v
from mapwise.functions.answers import strip, strip_column

__all__ = ["strip", "strip_column", "any_of", "bullet_class", "holds", "is_boundary", "is_heading_of", "is_title", "is_upper", "normal_heading",
           "plain_label", "word_count"]


def any_of(items: list[str]) -> str:
    """Pattern of a text that contains one of the items."""
    return "|".join(re.escape(i).replace("\\ ", " ").replace("\\-", "-").replace("\\&", "&") for i in items)


def is_upper(t: Column) -> Column:
    return t.rlike(v.UPPER) & ~t.rlike(v.LOWER)


def is_title(t: Column) -> Column:
    return t.rlike(v.UPPER) & ~t.rlike(v.TITLE_BREAK)


def word_count(t: Column) -> Column:
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, r"\s+")))


def plain_label(t: Column) -> Column:
    """Lower case without trailing colons."""
    return F.regexp_replace(F.lower(t), ":+$", "")


def normal_heading(t: Column) -> Column:
    """As ``plain_label`` without a section number in front, of a plain column, which is named several times here.

    Both patterns are tried only on lines that they can change, since each try goes through the whole line.
    """
    last = t.endswith(":")
    for end in "\n\r\u0085\u2028\u2029":  # ``$`` matches before a line end, too
        last = last | t.endswith(end)
    label = F.when(last, plain_label(t)).otherwise(F.lower(t))
    numbered = F.substr(t, F.lit(1), F.lit(1)).between("0", "9")
    return F.when(numbered, F.regexp_replace(plain_label(t), v.SECTION_NUMBER, "")).otherwise(label)


def holds(x: Column, phrases: list[str]) -> Column:
    """The text contains one of the phrases; plain searches cost less than a pattern on every line."""
    found = F.contains(x, F.lit(phrases[0]))
    for phrase in phrases[1:]:
        found = found | F.contains(x, F.lit(phrase))
    return found


def is_heading_of(n: Column, headings: list[str]) -> Column:
    """The line, or what follows its first colon, is one of the headings.

    ``n`` is the line's ``normal_heading``. It is used several times, so it should be a column computed once.
    """
    tail = F.when(F.instr(n, ":") > 0, strip(F.substr(n, F.instr(n, ":") + 1)))
    return n.isin(*headings) | F.coalesce(tail.isin(*headings), F.lit(False))


def is_boundary(t: Column, n: Column, stops: list[str], expected: list[str]) -> Column:
    """The line opens another section: a stop heading, a short line in capitals, or a numbered title.

    ``n`` is the line's ``normal_heading``, as for ``is_heading_of``.
    """
    few = F.size(F.split(strip_column(n), r"\s+", 7)) <= 6  # a long line is not split to its end
    looks = few & (is_upper(t) | t.rlike(v.NUMBERED_TITLE))
    return (F.length(n) > 0) & ~n.isin(*expected) & (n.isin(*stops) | looks)


def bullet_class(t: Column) -> Column:
    """Kind of bullet a line starts with: numbers by depth, a symbol, or a letter in brackets; else null."""
    mark = F.regexp_extract(t, v.BULLET, 1)
    dots = F.length(mark) - F.length(F.replace(mark, F.lit("."), F.lit("")))
    return (
        F.when(F.length(mark) == 0, F.lit(None).cast("string"))
        .when(mark.rlike("^[(]?[0-9]"), F.concat(F.lit("number"), dots.cast("string")))
        .when(mark.rlike(r"^\("), "letter").otherwise(mark)
    )
