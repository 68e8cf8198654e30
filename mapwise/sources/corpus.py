"""Document corpora as page lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from mapwise.plans.steps import computed_once

LINES_PER_PAGE = 12
#: Bytes of documents in a partition, about, and the fewest that one is cut down to so that small corpora use all cores.
#: Extractors sort the lines of a partition several times, each sort with a copy of its own.
PARTITION_BYTES, SMALL_BYTES = 8 << 20, 1 << 20
#: Bytes counted for a document besides its text: its row and the lines put in front.
DOCUMENT_BYTES = 2048

_CODE = "case doc_id % 4 when 0 then 'MATH' when 1 then 'HIST' when 2 then 'CHEM' else 'BIOL' end"
_NUM = "cast(100 + doc_id % 500 as string)"
_COURSE = f"{_CODE} || ' ' || {_NUM}"

# Syllabus lines put in front of each test document: (condition, text). Plain SQL both engines read;
# w1, w2, w3 are the first words of the document.
_INJECTED = [
    ("true", f"{_COURSE} || ' Syllabus'"),
    ("doc_id % 3 >= 1", f"'Welcome to ' || {_COURSE}"),
    ("doc_id % 3 = 2", f"'See ' || {_COURSE} || 'A for labs'"),
    ("doc_id % 4 = 0", "'Prerequisite PHYS 101'"),
    ("doc_id % 4 = 0", "'PHYS 101 or equal'"),
    ("doc_id % 2 = 0", "'Course Title: ' || w1 || ' ' || w2 || ' ' || w3"),
    ("doc_id % 6 = 1", f"{_COURSE} || ': Foundations of ' || w1"),
    ("doc_id % 6 = 3", "'Course Title:'"),
    ("doc_id % 6 = 3", "'Topics in ' || w2"),
    ("doc_id % 10 = 4", "'Course Code     Course Title        Credits'"),
    ("doc_id % 10 = 4", f"rpad({_COURSE}, 16, ' ') || rpad('Studies of ' || w1, 20, ' ') || '3'"),
    ("doc_id % 3 = 0", "'Offered in Fall 20' || cast(20 + doc_id % 5 as string)"),
    ("doc_id % 3 = 1", "'Classes run January 15, 2024 to April 8, 2024'"),
    ("doc_id % 3 = 1 and doc_id % 2 = 0", "'Grades are due in May 2025 and July 2025 and July 2024'"),
    ("doc_id % 2 = 1", "'Course description'"),
    ("doc_id % 2 = 1", "'This course covers ' || w1 || ' and ' || w2 || ' in depth.'"),
    ("doc_id % 2 = 1", "'it has lectures and labs every week'"),
    ("doc_id % 2 = 1", "'ASSESSMENT'"),
    ("true", "'Learning outcomes:'"),
    ("true", "'• Explain ' || w1 || ' in context'"),
    ("true", "'• Apply ' || w2"),
    ("true", "'with care and detail'"),
    ("true", "'• Describe ' || w3"),
    ("true", "''"),
    ("doc_id % 7 = 3", "'Components'"),
    ("doc_id % 7 = 3", "'essay one'"),
    ("doc_id % 7 = 3", "'essay two'"),
    ("doc_id % 7 = 3", "'Percentage'"),
    ("doc_id % 7 = 3", "'40%'"),
    ("doc_id % 7 = 3", "'60%'"),
    ("doc_id % 7 = 5", "'Component           Due date     Weight'"),
    ("doc_id % 7 = 5", "'Field report        March 1      25%'"),
    ("doc_id % 7 = 5", "'Group project                    35%'"),
    ("doc_id % 7 = 5", "'                    and talk     5%'"),
    ("doc_id % 7 = 5", "'Written test        April 20     35 pts'"),
    ("doc_id % 7 = 5", "'All of the course   -            100%'"),
    ("doc_id % 7 <> 3", "'Midterm: 30%'"),
    ("doc_id % 7 <> 3", "'Final Exam (70%)'"),
    ("doc_id % 7 <> 3 and doc_id % 5 = 1", "'Project'"),
    ("doc_id % 7 <> 3 and doc_id % 5 = 1", "'25 points'"),
    ("true", "'Late penalty 10%'"),
    ("doc_id % 3 <> 2", "'Topics'"),
    ("doc_id % 3 <> 2", "'• ' || w1 || ' basics'"),
    ("doc_id % 3 <> 2", "'• Final exam'"),
    ("doc_id % 3 <> 2", "'2) ' || lower(w2) || ' methods (Dr. Who)'"),
    ("doc_id % 3 <> 2", "'•'"),
    ("doc_id % 3 <> 2", "lower(w3) || ' in practice'"),
    ("doc_id % 3 <> 2", "'• ' || w1 || ' basics'"),
    ("doc_id % 3 = 2", "'Weekly Topics:'"),
    ("doc_id % 3 = 2", "'Module 1: ' || w1 || ' overview'"),
    ("doc_id % 3 = 2", "'Sept. 12, ' || w2 || ' review of models'"),
    ("doc_id % 3 = 2", "'some plain topic line'"),
    ("doc_id % 12 = 2", "'Week    Topic                         Readings'"),
    ("doc_id % 12 = 2", "'1       ' || rpad(w1 || ' and its history', 30, ' ') || 'Chapter 1'"),
    ("doc_id % 12 = 2", "'2       ' || rpad('Methods of ' || w2, 30, ' ') || 'Chapter 2'"),
    ("doc_id % 12 = 2", "'        used in the field             Notes'"),
    ("doc_id % 12 = 2", "'3       Final exam                    None'"),
    ("doc_id % 12 = 2", "'4       1. Models of growth           Chapter 3'"),
    ("doc_id % 12 = 2", "'        2. Maps of ' || w3"),
    ("doc_id % 12 = 8", "'Week    Topics                          Room'"),
    ("doc_id % 12 = 8", "'1                ' || rpad(w1 || ' systems in depth', 23, ' ') || 'B1'"),
    ("doc_id % 12 = 8", "'2                Water and its cycles   B2'"),
    ("doc_id % 12 = 8", "'3                Soil of many lands     B3'"),
    ("doc_id % 12 = 11", "'Date      Theme                  Assignment'"),
    ("doc_id % 12 = 11", "'May 3     ' || rpad('Rivers of ' || w3, 23, ' ') || 'Essay'"),
    ("doc_id % 12 = 11", "'May 10    Lakes and wetlands     Report'"),
    ("doc_id % 12 = 11", "'May 17    Module 1: Ice          Report'"),
    ("doc_id % 12 = 11", "'          Module 2: Snow cover   -'"),
    ("true", "'Course Policies'"),
    ("doc_id % 4 <> 3", "'Required Readings'"),
    ("doc_id % 4 <> 3", "'• Smith, J. (2019). Studies of the basics. Wiley.'"),
    ("doc_id % 4 <> 3", "'second part of the entry'"),
    ("doc_id % 4 <> 3", "'1. Handbook of methods, Springer 2015'"),
    ("doc_id % 4 <> 3", "'• Optional reading: Another article on models'"),
    ("doc_id % 8 = 1", "'Technology requirements for this course: mapping software'"),
    ("doc_id % 8 = 1", "'Some suggested reading materials for the term:'"),
    ("doc_id % 4 <> 3", "'• QGIS software guide'"),
    ("doc_id % 4 <> 3", "'free to install'"),
    ("doc_id % 4 <> 3", "'Field textbook: short text'"),
    ("doc_id % 4 <> 3", "'field textbook: a much longer text'"),
    ("doc_id % 4 <> 3", "'The course textbook is Big Book of Data.'"),
    ("true", "'ACADEMIC INTEGRITY'"),
]

FILE_NAME = (
    f"case when doc_id % 10 = 0 then lower({_CODE}) || '_' || {_NUM} || '_Fall2023.pdf' "
    f"when doc_id % 10 = 5 then {_CODE} || '-V ' || {_NUM} || ' 2022.pdf' "
    "else 'syllabus_' || cast(doc_id as string) || '.pdf' end"
)
_WORDS = ", ".join(f"split_part(replace(text, chr(10), ' '), ' ', {i}) as w{i}" for i in (1, 2, 3))
_LIST = ", ".join(f"case when {test} then {text} end" for test, text in _INJECTED)
_HEADER = "'SYL ' || cast(doc_id as string) || ' Page ' || cast(p + 1 as string) || ' of ' || cast(n_pages as string)"
_FOOTER = "'Printed by ' || source"
_BODY = LINES_PER_PAGE - 2

CHECK_ENGINE_CORPUS = f"""
    select doc_id, file_name, cast((pos // {LINES_PER_PAGE}) as bigint) as page_no, pos as line_no,
           case when pos % {LINES_PER_PAGE} = 0 then cast(0.02 as double)
                when pos % {LINES_PER_PAGE} = {LINES_PER_PAGE - 1} or pos = len(lines) - 1 then cast(0.95 as double)
                else cast(13 + 8 * (pos % {LINES_PER_PAGE} - 1) as double) / 100 end as rel_top, lines[pos + 1] as text
    from (select doc_id, file_name, lines, unnest(range(0, len(lines))) as pos
          from (select doc_id, file_name, flatten(list_transform(range(0, n_pages), lambda p:
                    [{_HEADER}] || list_slice(body, p * {_BODY} + 1, p * {_BODY} + {_BODY}) || [{_FOOTER}])) as lines
                from (select *, (len(body) + {_BODY - 1}) // {_BODY} as n_pages
                      from (select doc_id, source, {FILE_NAME} as file_name,
                                   list_filter([{_LIST}], lambda x: x is not null) || string_split(text, chr(10)) as body
                            from (select doc_id, source, text, {_WORDS} from @documents) a) b) c) d) e"""


def partitions_of(documents: DataFrame) -> int:
    """Number of partitions that keeps each at a fixed size, however large the corpus is."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + DOCUMENT_BYTES
    total = documents.agg(F.sum(size.cast("long"))).first()[0] or 1
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return max(math.ceil(total / PARTITION_BYTES), min(cores, math.ceil(total / SMALL_BYTES)))


def corpus_lines(documents: DataFrame) -> DataFrame:
    """Test corpus: (doc_id, file_name, page_no, line_no, rel_top, text).

    Documents are brought together by doc_id once, before their lines multiply; every later step that works
    within a document finds its lines in one partition and needs no exchange of its own. The number of partitions
    follows the bytes of the corpus, so that the memory of a task does not grow with it.
    """
    per_page, body = LINES_PER_PAGE, _BODY
    docs = documents.select("doc_id", "source", "text").repartition(partitions_of(documents), "doc_id")
    words = _WORDS.replace(", split_part", "|split_part").split("|")
    docs = computed_once(docs, **{f"w{i + 1}": F.expr(w.rsplit(" as ", 1)[0]) for i, w in enumerate(words)})
    docs = computed_once(docs, body=F.expr(f"concat(array_compact(array({_LIST})), split(text, chr(10)))"))
    docs = computed_once(docs, file_name=F.expr(FILE_NAME), n_pages=F.expr(f"cast((size(body) + {body - 1}) div {body} as bigint)"))
    staged = computed_once(docs, lines=F.expr(f"""flatten(transform(sequence(0L, n_pages - 1), p ->
        concat(array({_HEADER}), slice(body, cast(p * {body} + 1 as int), {body}), array({_FOOTER}))))"""))
    last = F.col("line_no") == F.col("n_lines") - 1
    in_page = F.col("line_no") % per_page
    rel_top = (
        F.when(in_page == 0, 0.02).when((in_page == per_page - 1) | last, 0.95)
        .otherwise((13 + 8 * (in_page - 1)).cast("double") / 100)
    )
    return staged.select("doc_id", "file_name", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "text")).withColumn(
        "line_no", F.col("pos").cast("long")
    ).select(
        "doc_id", "file_name", F.floor(F.col("line_no") / per_page).cast("long").alias("page_no"), "line_no",
        rel_top.alias("rel_top"), "text",
    )


def load_corpus(spark: SparkSession, path: str, lines_per_page: int = 40) -> DataFrame:
    """Documents stored as parquet (doc_id, text) as blocks (doc_id, page_no, block_no, rel_top, text).

    Form feeds end a page where the text has them; otherwise pages hold ``lines_per_page`` lines.
    """
    text = F.col("text")
    pages = F.split(text, "\f")
    lines = F.split(text, "\n")
    n_pages = F.ceil(F.size(lines) / lines_per_page).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), n_pages - 1), lambda p: F.slice(lines, p * lines_per_page + 1, lines_per_page)
    )
    by_page = F.when(F.size(pages) > 1, F.transform(pages, lambda p: F.split(p, "\n"))).otherwise(cut)
    documents = spark.read.schema("doc_id bigint, text string").parquet(path)
    return (
        documents.repartition(partitions_of(documents), "doc_id")
        .select("doc_id", F.posexplode(by_page).alias("page_no", "page"))
        .select("doc_id", "page_no", F.size("page").alias("n"), F.posexplode("page").alias("block_no", "text"))
        .select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("block_no").cast("long").alias("block_no"),
                (F.col("block_no") / F.col("n")).alias("rel_top"), "text")
    )
