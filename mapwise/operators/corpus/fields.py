"""Running headers, course code, title and term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mapwise.functions import rules, vocabulary as v
from mapwise.functions.text import strip
from mapwise.operators.corpus.pages import table_titles
from mapwise.plans.steps import computed_once

NO_CODE, NO_NUMBER = "TEST", 999


def strip_headers(lines: DataFrame) -> DataFrame:
    """Drop running headers and footers.

    A text in the top or bottom tenth of the page, with digits blanked where it looks like a page number,
    that occurs on at least 80 % of the pages is dropped wherever it stands in the document.
    """
    t = strip(F.col("text"))
    norm = F.when(t.rlike(v.PAGE_NUMBER_TEXT), F.regexp_replace(t, r"[0-9]+", "<NUM>")).otherwise(t)
    zone = F.when(F.col("rel_top") < 0.1, "top").when(F.col("rel_top") > 0.9, "bottom").otherwise("body")
    doc = Window.partitionBy("doc_id")
    rows = computed_once(lines, _norm=norm, _zone=zone).withColumn("_pages", F.max("page_no").over(doc) + 1)
    rows = rows.withColumn("_seen", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_zone", "_norm")))
    running = (F.col("_zone") != "body") & (F.col("_seen") >= F.floor(F.col("_pages") * 0.8))
    rows = rows.withColumn("_drop", F.max(running).over(Window.partitionBy("doc_id", "_norm")))
    return rows.filter(~F.col("_drop")).select(*lines.columns)


def base_name(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def course_code(lines: DataFrame) -> DataFrame:
    """Code and number: from the file name, else the most frequent code in the text, the earliest on ties."""
    in_name = base_name(F.col("file_name"))
    found = F.filter(F.regexp_extract_all("text", F.lit(v.TEXT_CODE), F.lit(1)), lambda c: c.rlike(v.WHOLE_CODE))
    codes = F.transform(found, lambda c: F.regexp_replace(c, "[A-Z]$", ""))
    counted = (
        lines.select("doc_id", "file_name", "line_no", F.posexplode_outer(codes).alias("at", "found"))
        .groupBy("doc_id", "found")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "at")).alias("first"), F.max("file_name").alias("file_name"))
    )
    rank = F.struct(F.col("found").isNotNull(), F.col("n"), -F.col("first.line_no"), -F.col("first.at"))
    best = counted.groupBy("doc_id").agg(F.max_by("found", rank).alias("found"), F.max(in_name).alias("name"))
    letters, digits = F.regexp_extract("name", v.FILE_NAME_CODE, 1), F.regexp_extract("name", v.FILE_NAME_CODE, 2)
    course = F.when(F.length(digits) > 0, F.concat(F.upper(letters), F.lit(" "), digits)).otherwise(F.col("found"))
    code = F.regexp_extract("course", "^([A-Za-z]+)", 1)
    number = F.regexp_extract("course", "([0-9]{3,})", 1)
    return computed_once(best, course=course).select(
        "doc_id", F.coalesce(F.nullif(code, F.lit("")), F.lit(NO_CODE)).alias("code"),
        F.coalesce(F.nullif(number, F.lit("")).cast("long"), F.lit(NO_NUMBER)).alias("number"),
    )


def course_title(lines: DataFrame, codes: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """Title: the one in a table; else the most frequent labelled or code-adjacent title, cleaned; else the first text
    line of the first page.

    ``codes`` holds the code and number per document, ``body`` the lines without running headers when the caller has
    them. Counts tie by first occurrence; candidates that name two of code, section and number are table headings.
    """
    body = strip_headers(lines) if body is None else body
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    rows = computed_once(lines, t=strip(F.col("text"))).withColumn("_next", F.lead("t").over(doc))
    rows = rows.join(codes.select("doc_id", "code", F.col("number").cast("string").alias("number")), "doc_id")
    course = F.concat_ws(" ", "code", "number")
    labelled = F.when(F.col("t").rlike(v.TITLE_LABEL),
                      F.coalesce(F.nullif(F.regexp_extract("t", v.TITLE_LABEL, 1), F.lit("")), F.col("_next")))
    rows = computed_once(rows, _course=course, _labelled=labelled)

    at = F.instr("t", F.concat("_course", F.lit(":")))
    named_here = F.contains("t", "_course")
    candidates = F.array_compact(F.array(
        "_labelled",
        F.when(at > 0, F.substr("t", at)),
        F.when(named_here, F.regexp_substr("t", F.concat("_course", F.lit(v.AFTER_DASH)))),
        F.when(named_here & F.rlike("t", F.concat(F.lit(v.BEFORE_COURSE), "_course", F.lit("$"))), F.col("t")),
        F.when(F.col("t").rlike(v.TITLE_BEFORE_CODE), F.col("t")),
    ))
    counted = (
        rows.select("doc_id", "code", "number", "line_no", F.posexplode_outer(candidates).alias("at", "title"))
        .groupBy("doc_id", "title")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "at")).alias("first"),
             F.max("code").alias("code"), F.max("number").alias("number"))
    )
    # Page numbers do not count as text.
    plain = body.filter("page_no = 0").select("doc_id", "line_no", strip(F.col("text")).alias("t"))
    plain = plain.filter((F.length("t") > 0) & ~F.col("t").rlike("^[0-9]+$"))
    first_lines = plain.groupBy("doc_id").agg(F.min_by("t", "line_no").alias("first_line"))
    low = F.lower("title")
    named = sum((low.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){w}(?:[^\p{{L}}\p{{N}}_]|$)").cast("int") for w in ("code", "section", "number")), F.lit(0))
    counted = counted.withColumn("_heading", F.coalesce(named > 1, F.lit(False)))
    top = F.max(F.when(F.col("title").isNotNull(), F.col("n")))
    per_doc = counted.groupBy("doc_id").agg(
        top.alias("top"), F.max("code").alias("code"), F.max("number").alias("number"),
        F.max_by("title", F.when(F.col("title").isNotNull() & ~F.col("_heading"),
                                 F.struct(F.col("n"), -F.col("first.line_no"), -F.col("first.at")))).alias("title"),
        F.max(F.when(~F.col("_heading") & F.col("title").isNotNull(), F.col("n"))).alias("n"),
    )
    per_doc = per_doc.join(first_lines, "doc_id", "left")
    name = F.concat_ws(" ", "code", "number")
    fallback = F.coalesce("first_line", name)
    bare = F.replace(F.replace("title", F.col("code"), F.lit("")), F.col("number"), F.lit(""))
    bare = strip(F.regexp_replace(bare, r"[!-/:-@\[-`{-~]", ""))
    rows = computed_once(per_doc, _bare=F.when(F.col("n") == F.col("top"), bare), _name=name, _fallback=fallback)
    title = (
        F.when(F.col("_bare").isNull(), F.col("_fallback"))
        .when(F.lower("_bare").isin("course code number", "course code"), F.col("_name"))
        .otherwise(F.coalesce(F.nullif(strip(F.regexp_replace("_bare", "^–", "")), F.lit("")), F.col("_fallback")))
    )
    tabled = table_titles(lines).select("doc_id", F.col("title").alias("_tabled"))
    return rows.join(tabled, "doc_id", "left").select("doc_id", F.coalesce("_tabled", title).alias("title"))


def course_term(lines: DataFrame, month: int, year: int) -> DataFrame:
    """Term code and year.

    An explicit term with a year wins, in the file name before the text (first match of the first page that
    has one). Otherwise the term is the explicit one without year, or follows from the most frequent month;
    the year is the one in the file name or the most frequent. A course whose months fall in January to April
    belongs to the academic year before, unless the following year is named too. ``month`` and ``year`` stand
    in for what a document does not tell.
    """
    match = F.nullif(F.regexp_extract("text", v.TERM, 1), F.lit(""))
    has_month = F.col("text").rlike("|".join(v.MONTH_SHORT))
    words = F.filter(F.regexp_extract_all("text", F.lit(v.WORD), F.lit(0)), lambda w: w.isin(*v.MONTH_NUMBER))
    number = F.create_map(*[F.lit(x) for pair in v.MONTH_NUMBER.items() for x in pair])
    months = F.transform(F.when(has_month, words), lambda w: number[w])
    years = F.regexp_extract_all("text", F.lit(v.YEAR), F.lit(0))
    rows = computed_once(
        lines.select("doc_id", "file_name", "page_no", "line_no", "text"), _match=match, _months=months, _years=years
    )
    # One aggregation per document: counts of the twelve months, explicit terms by page, years by first place.
    def mentions(month_no: int) -> Column:
        return F.coalesce(F.size(F.filter("_months", lambda m: m == month_no)), F.lit(0))

    counts = [F.sum(mentions(i)).alias(f"m{i}") for i in range(1, 13)]
    pages = rows.groupBy("doc_id", "page_no").agg(
        F.min(F.when(F.col("_match").isNotNull(), F.struct("line_no", "_match")))["_match"].alias("match"),
        F.max("file_name").alias("file_name"), *counts,
    )
    explicit_year = F.regexp_extract("match", v.YEAR, 0) != ""
    docs = pages.groupBy("doc_id").agg(
        F.max(base_name(F.col("file_name"))).alias("name"),
        F.min(F.when(explicit_year, F.struct("page_no", "match")))["match"].alias("dated"),
        F.max(F.when(~explicit_year, F.struct("page_no", "match")))["match"].alias("undated"),
        *[F.sum(f"m{i}").alias(f"m{i}") for i in range(1, 13)],
    )
    counted_years = (
        rows.select("doc_id", "line_no", F.posexplode("_years").alias("at", "y"))
        .groupBy("doc_id", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "at")).alias("first"))
        .groupBy("doc_id").agg(
            F.max_by("y", F.struct(F.col("n"), -F.col("first.line_no"), -F.col("first.at"))).alias("top_year"),
            F.max("n").alias("top_n"), F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("year_counts"),
        )
    )
    rows = docs.join(counted_years, "doc_id", "left")
    in_name = F.nullif(F.regexp_extract("name", v.TERM, 1), F.lit(""))
    rows = computed_once(rows, _in_name=in_name, _most=F.greatest(*[f"m{i}" for i in range(1, 13)]))
    named_year = F.nullif(F.regexp_extract("_in_name", v.YEAR, 0), F.lit(""))
    first_month = F.lit(12)
    for i in range(11, 0, -1):
        first_month = F.when(F.col(f"m{i}") == F.col("_most"), i).otherwise(first_month)
    rows = computed_once(
        rows,
        _explicit=F.when(named_year.isNotNull(), F.col("_in_name")).otherwise(F.col("dated")),
        _undated=F.coalesce("undated", F.when(named_year.isNull(), F.col("_in_name"))),
        _month=first_month,
        _year=F.coalesce(F.nullif(F.regexp_extract("name", v.YEAR, 0), F.lit("")), F.col("top_year")),
    )

    def term_name(found: Column) -> Column:
        rule = F.lit("")
        for pattern, name in reversed(v.TERM_NAMES):
            rule = F.when(found.rlike(pattern), name).otherwise(rule)
        return rule

    by_month = (
        F.when(F.col("_month") <= 4, "Winter Term 2").when(F.col("_month") <= 6, "Summer Term 1")
        .when(F.col("_month") <= 8, "Summer Term 2").otherwise("Winter Term 1")
    )
    numeric = F.col("_year").cast("long")
    is_top = F.coalesce(F.try_element_at("year_counts", "_year") == F.col("top_n"), F.lit(False))
    next_named = F.coalesce(F.map_contains_key("year_counts", (numeric + 1).cast("string")), F.lit(False))
    shifted = F.when((F.col("_month") <= 4) & is_top & (F.col("_most") > 0) & ~next_named, numeric - 1).otherwise(numeric)
    explicit = F.col("_explicit").isNotNull()
    half = F.col("_undated").isNotNull() & F.col("_year").isNotNull()
    term = F.when(explicit, term_name(F.col("_explicit"))).when(half, term_name(F.col("_undated"))).otherwise(by_month)
    final_year = (
        F.when(explicit, F.regexp_extract("_explicit", v.YEAR, 0).cast("long")).when(half, numeric).otherwise(shifted)
    )
    return rows.select(
        "doc_id", rules.term_code(term, month).alias("term"), F.coalesce(final_year, F.lit(year)).cast("long").alias("year")
    )
