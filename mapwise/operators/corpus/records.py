"""One course record per document and its child rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mapwise.functions import rules
from mapwise.operators.corpus.assessments import assessment_items
from mapwise.operators.corpus.fields import course_code, course_term, course_title, strip_headers
from mapwise.operators.corpus.materials import clean_materials, material_items
from mapwise.operators.corpus.sections import clean_topics, goal_items, section_text, topic_items
from mapwise.plans.session import kept

CHILD = ["doc_id", "kind", "position", "name", "detail", "type"]


def course_children(lines: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """Outcomes, assessments, topics and materials of every document, long, with 1-based positions.

    Word documents have no pages to read topics and materials from, so they yield neither.
    ``body`` holds the lines without running headers when the caller has them already.
    What each extractor finds is kept by itself: Spark holds the compiled code of 100 steps, and a stage of all extractors
    has more, so that every task may compile them anew and hold the sorts of all of them at once.
    """
    body = strip_headers(lines) if body is None else body
    paged = body.filter(~F.lower("file_name").endswith(".docx"))
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, name: str, detail=none, type_=none) -> DataFrame:
        return df.select("doc_id", F.lit(kind).alias("kind"), "position", F.col(name).alias("name"),
                         detail.alias("detail"), type_.alias("type"))

    return (
        rows(kept(goal_items(body)), "outcome", "goal")
        .unionByName(rows(kept(assessment_items(lines)), "assessment", "name", F.col("weight").cast("string")))
        .unionByName(rows(kept(clean_topics(topic_items(paged))), "topic", "topic"))
        .unionByName(rows(kept(clean_materials(material_items(paged))), "material", "name", F.col("description"), F.col("type")))
    )


def course_records(lines: DataFrame, month: int, year: int) -> DataFrame:
    """One course row per document with the number of child rows of each kind.

    Eight extractors read the lines, so they are kept once, by document, instead of being rebuilt for each. So is what each
    extractor finds (see ``course_children``).
    """
    lines = kept(lines)
    body = kept(strip_headers(lines))
    codes = kept(course_code(lines))
    titles, terms, texts = kept(course_title(lines, codes, body)), kept(course_term(lines, month, year)), kept(section_text(body))
    children = course_children(lines, body).groupBy("doc_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}s") for kind in ("outcome", "assessment", "topic", "material")]
    )
    counts = [F.coalesce(f"n_{kind}s", F.lit(0)).alias(f"n_{kind}s") for kind in ("outcome", "assessment", "topic", "material")]
    return (
        codes.join(titles, "doc_id").join(terms, "doc_id").join(texts, "doc_id", "left").join(children, "doc_id", "left")
        .select("doc_id", "code", "number", "title", "term", "year", rules.study_level(F.col("number")).alias("level"),
                F.coalesce("description", F.lit("")).alias("description"), *counts)
    )
