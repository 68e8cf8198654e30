"""Tables in text pages: columns by the gaps that all lines of a run share, and what titles, weights and topics they hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from mapwise.functions import vocabulary as v
from mapwise.functions.text import any_of, holds, is_heading_of, normal_heading, strip, strip_column
from mapwise.plans.steps import computed_once

#: Longer lines are prose, whatever gaps they have.
WIDEST = 400
_BREAK = "\u0001"


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, "^ +| +$", "")


def page_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, rows): the tables of every page, ``rows`` being lists of cells in order.

    A run is made of neighbouring lines of a page that have a gap of two or more blanks inside, and of the indented lines
    below them; its first line has a gap. The lines of a run vote: a place at which all of them are blank is a gap of the
    table, and each gap of two or more such places parts two columns. A line whose first cell is blank goes on with the
    row above, cell by cell, as a wrapped line does. Runs without a common gap are no tables; a run of one line is a table
    of one row, which may be a header cut off by the end of a page. Tabs stand for four blanks; lines over ``WIDEST``
    characters, null and blank lines end a run, as do numbers of lines left out.
    """
    t = F.regexp_replace(F.replace("text", F.lit("\t"), F.lit("    ")), " +$", "")
    # Most lines have no gap: they go before anything is sorted, and neighbours are told by their numbers.
    rows = lines.filter(F.col("text").rlike(r"[ \t]{2}|\t")).select("doc_id", "page_no", "line_no", t.alias("t"))
    rows = computed_once(rows, _gap=F.col("t").rlike("[^ ] {2,}[^ ]")).filter(
        (F.length("t") <= WIDEST) & (F.col("_gap") | F.col("t").rlike("^ {2,}[^ ]")))
    page = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    rows = rows.withColumn("_run", F.col("line_no") - F.row_number().over(page))
    begun = F.max("_gap").over(Window.partitionBy("doc_id", "page_no", "_run").orderBy("line_no"))
    runs = (
        rows.withColumn("_begun", begun).filter("_begun").groupBy("doc_id", "page_no", "_run")
        .agg(F.min("line_no").alias("first_line"), F.max(F.length("t")).alias("width"),
             F.sort_array(F.collect_list(F.struct("line_no", "t"))).alias("_lines"))
    )
    # The lists hold lines of one page.
    runs = computed_once(runs, lines=F.transform("_lines", lambda e: e["t"]))
    vote = F.transform(
        F.sequence(F.lit(1), "width"),
        lambda p: F.forall("lines", lambda e: F.substr(e, p, F.lit(1)).isin("", " ")))
    runs = computed_once(runs, gap=vote)

    def gap(p: Column) -> Column:
        return F.get("gap", p - 1)

    starts = F.filter(
        F.sequence(F.lit(1), "width"),
        lambda p: ~gap(p) & ((p == 1) | (gap(p - 1) & ((p == 2) | gap(p - 2)))))
    runs = computed_once(runs, starts=starts).filter(F.size("starts") > 1)

    def cut(line: Column) -> Column:
        end = F.col("width") + 1
        return F.transform("starts", lambda s, i: _trimmed(F.substr(line, s, F.coalesce(F.get("starts", i + 1), end) - s)))

    runs = computed_once(runs, cells=F.transform("lines", cut))
    heads = F.filter(
        F.sequence(F.lit(0), F.size("cells") - 1), lambda i: (i == 0) | (F.get(F.get("cells", i), F.lit(0)) != ""))
    runs = computed_once(runs, heads=heads)

    def row(head: Column, k: Column) -> Column:
        own = F.slice("cells", head + 1, F.coalesce(F.get("heads", k + 1), F.size("cells")) - head)
        return F.transform(
            "starts", lambda _, c: F.array_join(F.filter(F.transform(own, lambda r: F.get(r, c)), lambda x: x != ""), "\n"))

    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")).cast("long")
    found = computed_once(runs, rows=F.transform("heads", row))
    return found.select("doc_id", "page_no", number.alias("table_no"), "rows")


def table_cells(lines: DataFrame) -> DataFrame:
    """The cells of ``page_tables``: (doc_id, page_no, table_no, row_no, col_no, cell), numbers from 1; blank cells count."""
    rows = page_tables(lines).select("doc_id", "page_no", "table_no", F.posexplode("rows").alias("r", "cells"))
    return rows.select(
        "doc_id", "page_no", "table_no", (F.col("r") + 1).cast("long").alias("row_no"), F.posexplode("cells").alias("c", "cell")
    ).select("doc_id", "page_no", "table_no", "row_no", (F.col("c") + 1).cast("long").alias("col_no"), "cell")


def _filled(cells: Column) -> Column:
    return F.filter(cells, lambda x: x != "")


def _place(heads: Column, names: list[str]) -> Column:
    """Place of the first heading that is one of the names, from 0; null without."""
    found = F.filter(F.transform(heads, lambda h, i: F.when(F.lower(h).isin(*names), i)), lambda i: i.isNotNull())
    return F.get(found, F.lit(0))


def table_titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title): the cell below a 'course title' heading.

    Blank cells are left out of both rows before the places are compared. The first such table of a page counts, and the
    first page that has a title below it.
    """
    tables = page_tables(lines)
    tables = computed_once(tables, _head=_filled(F.get("rows", F.lit(0))), _row=_filled(F.get("rows", F.lit(1))))
    tables = computed_once(tables, _at=_place(F.col("_head"), v.TITLE_TABLE_COLUMNS)).filter(F.col("_at").isNotNull())
    pages = tables.groupBy("doc_id", "page_no").agg(F.min_by(F.get("_row", F.col("_at")), "table_no").alias("title"))
    return pages.filter(F.col("title").isNotNull()).groupBy("doc_id").agg(F.min_by("title", "page_no").alias("title"))


def table_weights(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, nth, name, weight): the weighted assessments of the first page whose tables list any.

    The first table of a page with a name and a weight heading counts, blank cells left out of every row. A wrapped cell
    is one assessment a line, names and weights paired in order; weights of 100 and cells without a digit do not count.
    """
    tables = page_tables(lines)
    tables = computed_once(tables, _rows=F.transform("rows", _filled))
    head = F.get("_rows", F.lit(0))
    tables = computed_once(tables, _name=_place(head, v.ASSESSMENT_NAME_COLUMNS), _mark=_place(head, v.ASSESSMENT_MARK_COLUMNS))
    tables = tables.filter(F.col("_name").isNotNull() & F.col("_mark").isNotNull())
    body = F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))
    pairs = F.filter(
        F.transform(body, lambda r: F.struct(F.get(r, F.col("_name")).alias("name"), F.get(r, F.col("_mark")).alias("weight"))),
        lambda p: p["name"].isNotNull() & F.coalesce(p["weight"].rlike("[0-9]"), F.lit(False)))
    tables = computed_once(tables, _pairs=pairs).filter(F.size("_pairs") > 0)

    def lines_of(pair: Column) -> Column:
        names, weights = F.split(pair["name"], "\n"), F.split(pair["weight"], "\n")
        return F.transform(
            F.sequence(F.lit(0), F.least(F.size(names), F.size(weights)) - 1),
            lambda i: F.struct(F.get(names, i).alias("name"), F.get(weights, i).alias("weight")))

    first = tables.groupBy("doc_id", "page_no").agg(F.min_by("_pairs", "table_no").alias("_pairs"))
    found = computed_once(first, _items=F.filter(
        F.flatten(F.transform("_pairs", lines_of)), lambda p: ~F.contains(p["weight"], F.lit("100"))))
    found = found.filter(F.size("_items") > 0).groupBy("doc_id").agg(
        F.min("page_no").alias("page_no"), F.min_by("_items", "page_no").alias("_items"))
    items = found.select("doc_id", "page_no", F.posexplode("_items").alias("nth", "item"))
    number = F.regexp_extract("item.weight", r"([0-9]+\.?[0-9]*)", 1)
    return items.select("doc_id", "page_no", "nth", F.col("item.name").alias("name"), number.alias("weight")).filter(
        "weight <> ''").withColumn("weight", F.col("weight").cast("double"))


def _heading(x: Column) -> Column:
    """A column heading for comparison: lower case, 'and' for &, without brackets, percent signs, stars and colons."""
    plain = F.replace(F.replace(F.lower(x), F.lit("&"), F.lit("and")), F.lit("/"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(plain, "[%()*:]", ""), r"\s+", " "))


def _any(headings: Column, names: list[str]) -> Column:
    return F.arrays_overlap(headings, F.array(*map(F.lit, names)))


def _places(headings: Column, test: Callable[[Column], Column]) -> Column:
    """Places from 0 of the headings that pass the test."""
    return F.filter(F.transform(headings, lambda h, i: F.when(test(h), i)), lambda i: i.isNotNull())


def _topic_like(rows: Column, column: Column) -> Column:
    """Of the first six cells of a column: how many are filled, look like topics, or look like dates and logistics."""
    cells = F.filter(
        F.transform(F.slice(rows, 1, 6), lambda r: strip(F.regexp_replace(F.get(r, column), r"\s+", " "))), lambda x: x != "")
    low = F.lower
    verbs = "^(?:" + any_of(v.GOAL_VERBS[:-3]) + ")"

    def bad(x: Column) -> Column:
        found = low(x).rlike(verbs)
        for pattern in v.NOT_TOPIC_CELLS:
            found = found | low(x).rlike(pattern)
        return found

    return F.struct(
        F.size(cells).alias("n"),
        F.size(F.filter(cells, lambda x: ~bad(x) & (F.regexp_count(x, F.lit(v.TOPIC_WORD)) >= 2))).alias("good"),
        F.size(F.filter(cells, bad)).alias("bad"))


def _rescued(place: Column, looks: Column) -> Column:
    """The place, or its neighbour where the header stands over an empty or wrong column and topics stand beside it."""

    def look(i: Column, what: str) -> Column:
        return F.coalesce(F.get(looks, i)[what], F.lit(0))

    def better(i: Column, than: Column) -> Column:
        good = look(i, "good")
        return (good >= 2) & (look(i, "bad") <= good) & (good > than)

    own = look(place, "good")
    usable = (look(place, "n") > 0) & (own >= 1) & (look(place, "bad") <= own)
    left = better(place - 1, own)
    right = better(place + 1, F.when(left, look(place - 1, "good")).otherwise(own))
    return F.when(usable, place).when(right, place + 1).when(left, place - 1).otherwise(place)


def _cell_topics(cell: Column) -> Column:
    """The topics of one cell: its list items or modules, where it has more than one, or all its lines as one topic."""
    lines = F.filter(F.transform(F.split(cell, "\n"), strip), lambda x: (x != "") & ~x.rlike(v.CELL_ADMIN))
    lines = F.transform(lines, lambda x: F.when(
        x.rlike(v.CELL_NO_LABS), strip(F.regexp_extract(x, v.CELL_NO_LABS, 1))).otherwise(x))

    def parted(marked: Column) -> Column:
        return F.filter(F.transform(F.split(F.array_join(marked, " "), _BREAK), strip), lambda x: x != "")

    items = F.transform(lines, lambda x: F.regexp_replace(x, v.CELL_LIST_MARK, _BREAK))
    modules = F.transform(lines, lambda x: F.when(x.rlike(v.CELL_MODULE), F.concat(F.lit(_BREAK), x)).otherwise(x))

    def marks(x: Column) -> Column:
        return F.size(F.filter(x, lambda y: y.startswith(_BREAK)))

    return F.when(marks(items) > 1, parted(items)).when(marks(modules) > 1, parted(modules)).otherwise(
        F.filter(F.array(strip(F.array_join(lines, " "))), lambda x: x != ""))


def topic_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no) of the pages of the topic section.

    The section opens at the first topic heading and ends on the page of the next stop heading; pages that are a table of
    contents never belong to it. 'Lectures' on a page about the course structure and schedules of class times do not open
    it. Documents without such a heading take what follows a line 'course structure', whatever its pages are. Lines are
    only aggregated by page; what is sorted are pages.
    """
    rows = computed_once(lines.select("doc_id", "page_no", "line_no", "text"), t=strip_column(F.col("text")), _low=F.lower("text"))
    rows = computed_once(rows, _n=normal_heading(F.col("t")))
    low, timed = F.col("_low"), ["schedule", "course schedule", "class schedule"]
    rows = computed_once(
        rows, _is_lecture=is_heading_of(F.col("_n"), ["lecture", "lectures"]),
        _is_timed=is_heading_of(F.col("_n"), timed), _is_topic=is_heading_of(F.col("_n"), v.TOPIC_PAGE_HEADINGS))
    lecture, timed, topic = F.col("_is_lecture"), F.col("_is_timed"), F.col("_is_topic")

    def first(test: Column) -> Column:
        return F.min(F.when(test, F.col("line_no")))

    def any_line(test: Column) -> Column:
        return F.coalesce(F.max(test), F.lit(False))

    pages = rows.groupBy("doc_id", "page_no").agg(
        first(topic & ~lecture & ~timed).alias("_plain"), first(topic & lecture).alias("_lecture"),
        first(topic & timed).alias("_timed"), first(F.col("_n") == "course structure").alias("_loose"),
        F.max(F.when(F.col("_n").isin(*v.TOPIC_PAGE_STOPS), F.col("line_no"))).alias("_stop"),
        any_line(holds(low, v.CONTENTS_PAGES)).alias("_contents"), any_line(holds(low, ["course structure"])).alias("_structure"),
        any_line(holds(low, v.CLASS_TIMES) | (holds(low, ["orch"]) & low.rlike(v.ROOM_NUMBER))).alias("_times"),
        any_line(holds(low, ["module", "topic", "theme", "seminar"]) & low.rlike(v.TOPIC_SIGNALS)).alias("_signals"),
    )
    doc = Window.partitionBy("doc_id")
    opens = F.when(~F.col("_contents"), F.least(
        "_plain", F.when(~F.col("_structure"), F.col("_lecture")),
        F.when(~F.col("_times") | F.col("_signals"), F.col("_timed"))))
    pages = pages.withColumn("_opens", opens).withColumn("_open", F.min("_opens").over(doc)).withColumn(
        "_from", F.coalesce("_open", F.min("_loose").over(doc)))
    counts = F.col("_open").isNull() | ~F.col("_contents")
    begins = (F.col("_opens") == F.col("_from")) | (F.col("_open").isNull() & (F.col("_loose") == F.col("_from")))
    # Lines are numbered through the document, so the last stop of a page tells whether one stands below the opening line.
    ends = (F.col("_stop") > F.col("_from")) & counts
    pages = pages.withColumn("_first", F.min(F.when(begins, F.col("page_no"))).over(doc)).withColumn(
        "_last", F.min(F.when(ends, F.col("page_no"))).over(doc))
    return pages.filter(
        (F.col("page_no") >= F.col("_first")) & (F.col("_last").isNull() | (F.col("page_no") <= F.col("_last"))) & counts
    ).select("doc_id", "page_no")


def table_topics(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, topic): the cells of the topic columns on the pages of the topic section, numbered in order.

    A table's header is its first row, its first two where only together they name a topic column, or the one-row table
    cut off before it, if as wide. Topic columns carry a topic heading, else a module heading over titles, else a theme
    heading in a schedule; title columns count beside a schedule or topic column. Tables about assessments or travel hold
    no topics; once a topic table was seen, they end their page, but for schedules with assessments. A later table without
    topic columns of its own goes on with those of the last topic table, all its rows being topics. Where a column holds no topics
    but its neighbour does, the neighbour is read (a table that goes on starts from the last header's columns).
    """
    paged = page_tables(lines).join(topic_pages(lines), ["doc_id", "page_no"], "left_semi")
    tables = computed_once(paged, _n=F.size("rows"), _head=F.transform(F.get("rows", F.lit(0)), _heading))
    known = [*v.TOPIC_COLUMNS, *v.TITLE_COLUMNS, *v.MODULE_COLUMNS, *v.THEME_COLUMNS]
    stacked = F.transform("_head", lambda h, i: strip(F.concat_ws(
        " ", h, _heading(F.get(F.get("rows", F.lit(1)), i)))))
    doc = Window.partitionBy("doc_id").orderBy("table_no")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    tables = computed_once(tables, _stacked=F.when((F.col("_n") > 2) & ~_any(F.col("_head"), known), stacked))
    use = F.coalesce(_any(F.col("_stacked"), v.TOPIC_COLUMNS), F.lit(False))
    tables = computed_once(
        tables, _own=F.when(use, F.col("_stacked")).otherwise(F.col("_head")), _skip=F.when(use, 2).otherwise(1))
    cut_off = F.last(F.when(F.col("_n") == 1, F.col("_head")), True).over(before)
    tables = tables.withColumn("_cut", cut_off).filter(F.col("_n") > 1)
    carried = ~_any(F.col("_own"), known) & F.coalesce(F.size("_cut") == F.size("_own"), F.lit(False))
    tables = computed_once(tables, head=F.when(carried, F.col("_cut")).otherwise(F.col("_own")))
    head = F.col("head")
    near = F.flatten(F.transform(F.slice("rows", 1, 12), lambda r: F.transform(r, _heading)))
    tables = computed_once(
        tables, _topic=_any(head, v.TOPIC_COLUMNS), _schedule=_any(head, v.SCHEDULE_COLUMNS),
        _module=_any(head, v.MODULE_COLUMNS), _theme=_any(head, v.THEME_COLUMNS), _title=_any(head, v.TITLE_COLUMNS),
        _graded=_any(head, v.ASSESSMENT_COLUMNS), _travel=_any(head, v.ITINERARY_COLUMNS) | _any(near, v.ITINERARY_COLUMNS),
        _ignored=_any(head, v.IGNORED_COLUMNS), _after=F.slice("rows", F.col("_skip") + 1, F.col("_n")))

    def titled(place: Column) -> Column:
        cells = F.transform(F.slice("_after", 1, 7), lambda r: strip(F.regexp_replace(F.get(r, place), r"\s+", " ")))
        return F.exists(cells, lambda x: ~x.rlike(v.MODULE_LABEL) & (F.size(F.split(x, " ")) >= 3))

    def named(names: list[str]) -> Column:
        return _places(head, lambda h: h.isin(*names))

    modules = F.filter(named(v.MODULE_COLUMNS), titled)
    themes = F.when(F.col("_schedule"), named(v.THEME_COLUMNS)).otherwise(F.array().cast("array<int>"))
    tables = computed_once(tables, _topics=named(v.TOPIC_COLUMNS), _modules=modules, _themes=themes)
    main = F.when(F.size("_topics") > 0, F.col("_topics")).when(F.size("_modules") > 0, F.col("_modules")).otherwise(F.col("_themes"))
    titles = F.when(F.col("_schedule") | F.col("_topic"), named(v.TITLE_COLUMNS)).otherwise(F.array().cast("array<int>"))
    off = (F.col("_graded") | F.col("_travel")) & ~F.col("_topic")
    tables = computed_once(tables, _off=off, _found=F.when(off, F.array().cast("array<int>")).otherwise(F.concat(main, titles)))
    # The first topic table is never cut off, so whether one was seen follows from the tables before alone.
    tables = tables.withColumn("_seen", F.coalesce(F.max(F.size("_found") > 0).over(before), F.lit(False)))
    ends = F.col("_off") & F.col("_seen") & ~(F.col("_graded") & F.col("_schedule"))
    page = Window.partitionBy("doc_id", "page_no").orderBy("table_no").rowsBetween(Window.unboundedPreceding, -1)
    tables = tables.withColumn("_ended", F.coalesce(F.max(ends).over(page), F.lit(False)))
    listed = ~F.col("_ended") & (F.size("_found") > 0)
    tables = tables.withColumn("_last", F.last(F.when(listed, F.col("_found")), True).over(before))
    first_cell = F.get(F.get("rows", F.lit(0)), F.lit(0))
    lost = (F.array_max("_last") >= F.size("head")) & first_cell.rlike(r"^[0-9]+(?:\s|$)") & (F.size("head") > 1)
    places = F.when(F.size("_found") > 0, F.col("_found")).when(
        ~F.col("_off") & F.col("_last").isNotNull(), F.when(lost, F.array(F.lit(1))).otherwise(F.col("_last")))
    tables = computed_once(tables.filter("not _ended"), _places=places).filter(F.size("_places") > 0)
    headed = F.col("_topic") | F.col("_module") | F.col("_theme")
    tables = computed_once(
        tables, _sample=F.when(headed | (F.col("_skip") > 1) | F.col("_title"), F.col("_after")).otherwise(F.col("rows")),
        _read=F.when(headed, F.col("_after")).otherwise(F.col("rows")))
    tables = computed_once(tables, _looks=F.transform("head", lambda _, i: _topic_like(F.col("_sample"), i)))
    tables = computed_once(
        tables, _at=F.array_distinct(F.transform("_places", lambda i: _rescued(i, F.col("_looks")))))
    rows = tables.select("doc_id", "table_no", "head", "_at", F.posexplode("_read").alias("row_no", "_row"))
    cells = rows.select("doc_id", "table_no", "row_no", "head", "_row", F.posexplode("_at").alias("at", "_i"))
    own = strip(F.coalesce(F.get("_row", F.col("_i")), F.lit("")))
    beside = (
        F.get("head", F.col("_i")).isin(*v.THEME_COLUMNS, "topic speaker") & (F.get("head", F.col("_i") - 1) == "")
        & (F.col("_i") < F.size("_row")))
    cell = F.when((own == "") & F.coalesce(beside, F.lit(False)), strip(F.get("_row", F.col("_i") - 1))).otherwise(own)
    cells = computed_once(cells, _cell=cell).filter("_cell <> ''")
    topics = computed_once(cells, _parts=_cell_topics(F.col("_cell"))).select(
        "doc_id", "table_no", "row_no", "at", F.posexplode("_parts").alias("nth", "topic"))
    order = Window.partitionBy("doc_id").orderBy("table_no", "row_no", "at", "nth")
    return topics.select("doc_id", F.row_number().over(order).cast("long").alias("line_no"), "topic")
