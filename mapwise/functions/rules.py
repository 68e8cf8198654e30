"""Column rules used inside the operators. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
NOT_APPLICABLE = 0
WHITE = "#ffffff"
WHITES = ("#ffffff", "#fff")
GREY = "#6c757d"
STANDARDS_CATEGORY_OF_LEVEL = {"Undergraduate": 1, "Bachelors": 1, "Masters": 2, "Doctoral": 3}
SCALE_FAMILY_ORDERS = {1: ["I", "D", "A"], 2: ["Mi", "Ma", "S", "P"], 3: ["Y"], 4: ["F", "E"]}
AGE_UNITS = [
    (60 * 60 * 24 * 365, "year"), (60 * 60 * 24 * 30, "month"), (60 * 60 * 24 * 7, "week"),
    (60 * 60 * 24, "day"), (60 * 60, "hour"), (60, "min"), (1, "second"),
]
TERM_CODES = {"Winter Term 1": "W1", "Winter Term 2": "W2", "Summer Term 1": "S1", "Summer Term 2": "S2"}
TERM_CODE_OF_MONTH = {1: "W2", 5: "S1", 7: "S2", 9: "W1"}  # first month of each span


def scope_array(course_num: Column, required: Column) -> Column:
    """The scopes one course of a program belongs to, as an array."""
    first = F.substring(course_num, 1, 1)
    tests = [
        (F.lit(True), "all"),
        (required == 1, "required"),
        (required == 0, "non_required"),
        (first == "1", "year1"),
        (first == "2", "year2"),
        (first == "3", "year3"),
        (first == "4", "year4"),
        (first.isin("5", "6"), "graduate"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def level_bucket(course_num: Column) -> Column:
    first = F.substring(course_num, 1, 1)
    return F.when(first.isin(*"123456"), F.concat(first, F.lit("00"))).otherwise("Other")


def capitalise_words(text: Column) -> Column:
    """First character of every word upper-cased, the rest untouched."""
    return F.array_join(
        F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
        " ",
    )


def standards_category(level: Column) -> Column:
    """Standards category a program level is measured against; unknown levels use category 0."""
    rule = F.lit(0)
    for name, category in STANDARDS_CATEGORY_OF_LEVEL.items():
        rule = F.when(level == name, category).otherwise(rule)
    return rule.cast("long")


def series_colour(colour: Column) -> Column:
    """White is invisible in a chart series, so it turns grey."""
    return F.when(F.lower(colour).isin(*WHITES), GREY).otherwise(colour)


def age_phrase(seconds: Column) -> Column:
    """'3 weeks ago' in the largest unit that is not zero."""
    phrase = F.lit("0 seconds ago")
    for size, unit in reversed(AGE_UNITS):
        n = F.floor(seconds / size).cast("long")
        text = F.when(n == 1, f"1 {unit} ago").otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s ago")))
        phrase = F.when(n != 0, text).otherwise(phrase)
    return F.when(seconds.isNotNull(), phrase)


def family_rank(category: Column, abbreviation: Column, scale_id: Column) -> Column:
    """Order of a scale inside a family: N/A lowest, strangers 0, custom families by scale id."""
    rank = F.lit(0).cast("long")
    for family, order in SCALE_FAMILY_ORDERS.items():
        position = F.array_position(F.array(*[F.lit(a) for a in order]), abbreviation).cast("long")
        rank = F.when(category == family, position).otherwise(rank)
    rank = F.when(category.isNull(), scale_id).otherwise(rank)
    return F.when(scale_id == NOT_APPLICABLE, F.lit(-1).cast("long")).otherwise(rank)


def study_level(number: Column) -> Column:
    return F.when(number >= 500, "Graduate").otherwise("Undergraduate")


def term_code(term: Column, month: int) -> Column:
    """Code of a term; an unknown or missing term becomes the one ``month`` (1-12) falls in."""
    fallback = [code for first, code in TERM_CODE_OF_MONTH.items() if month >= first][-1]
    rule = F.lit(fallback)
    for name, code in TERM_CODES.items():
        rule = F.when(term == name, code).otherwise(rule)
    return rule


def pair_id(clo: Column, plo: Column) -> Column:
    return F.concat(F.lit("clo-"), clo.cast("string"), F.lit("__plo-"), plo.cast("string"))


PAIR_ID = r"^clo-([^_]+)__plo-(.+)"


def pair_part(composite: Column, group: int) -> Column:
    """Outcome id inside a pair id; null when the text is not one."""
    return F.nullif(F.regexp_extract(composite, PAIR_ID, group), F.lit(""))


def label_set(labels: Column, allowed: list[str]) -> Column:
    """Upper-cased distinct labels of an array whose items may hold several, comma-separated."""
    parts = F.flatten(F.transform(labels, lambda x: F.split(x, ",")))
    clean = F.transform(parts, lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.filter(clean, lambda x: x.isin(*allowed)))
