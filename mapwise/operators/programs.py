"""Programs and their courses: scopes, levels, labels, membership."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from mapwise.functions import rules
from mapwise.plans.numbering import number_rows
from mapwise.plans.skew import fan_out_join

Frames = Mapping[str, DataFrame]


def with_scopes(t: Frames) -> DataFrame:
    """(program, course, scope) for all eight scopes in one pass over the links."""
    return (
        t["course_programs"]
        .join(t["courses"].select("course_id", "course_num"), "course_id")
        .select(
            "program_id", "course_id",
            F.explode(rules.scope_array(F.col("course_num"), F.col("course_required"))).alias("scope"),
        )
    )


def courses_by_level(t: Frames) -> DataFrame:
    return (
        t["course_programs"]
        .join(t["courses"].select("course_id", "course_num"), "course_id")
        .groupBy("program_id", rules.level_bucket(F.col("course_num")).alias("level_bucket"))
        .agg(F.count(F.lit(1)).alias("n_courses"))
    )


def plo_labels(t: Frames) -> DataFrame:
    """Program outcomes with category and display label; positions put uncategorised outcomes last."""
    plos = t["program_learning_outcomes"].join(
        t["p_l_o_categories"].select("plo_category_id", "plo_category"), "plo_category_id", "left"
    )
    no_category = F.col("plo_category_id").isNull().cast("int")
    category = F.coalesce("plo_category_id", F.lit(-1))
    numbered = number_rows(
        plos,
        ["program_id"],
        [F.col("pl_outcome_id")],
        F.struct(no_category.alias("u"), category.alias("c"), F.floor(F.col("pl_outcome_id") / 4096).alias("b")),
        "position",
    )
    return numbered.select(
        "program_id", "pl_outcome_id", "plo_category_id", "plo_category", "position",
        F.when(F.length(F.trim("plo_shortphrase")) > 0, F.col("plo_shortphrase"))
        .otherwise(F.concat(F.lit("PLO #"), F.col("position").cast("string"))).alias("label"),
    )


def program_courses(t: Frames) -> DataFrame:
    """Courses of every program, by code then number as text."""
    return (
        t["course_programs"].join(t["programs"].select("program_id", "program"), "program_id")
        .join(t["courses"].select("course_id", "course_code", "course_num", "course_title"), "course_id")
        .select("program_id", "program", "course_id", "course_code", "course_num", "course_title", "course_required")
        .orderBy("program_id", "course_code", "course_num", "course_id")
    )


def courses_not_in_program(t: Frames) -> DataFrame:
    """For every user and program of theirs: the user's courses that are not in the program yet."""
    mine = fan_out_join(
        t["course_users"].select("user_id", "course_id"),
        t["program_users"].select("user_id", "program_id"),
        ["user_id"],
    )
    return mine.join(t["course_programs"].select("course_id", "program_id"), ["course_id", "program_id"], "left_anti")


def faculty_courses(t: Frames) -> DataFrame:
    """Courses of every faculty, by organisation names or by course code.

    A code only counts when the course names no organisation, the same one, or campus 'Other' alone.
    """
    faculties = t["faculties"].join(t["campuses"], "campus_id").select("faculty_id", "faculty", "campus")
    courses = t["courses"].select("course_id", "course_code", "campus", "faculty", "department")
    by_name = courses.join(faculties, ["campus", "faculty"]).select("faculty_id", "course_id")
    coded = t["faculty_course_codes"].join(faculties, "faculty_id").select(
        "course_code", "faculty_id", F.col("faculty").alias("code_faculty"), F.col("campus").alias("code_campus")
    )
    unnamed = F.col("campus").isNull() & F.col("faculty").isNull()
    same = (F.col("campus") == F.col("code_campus")) & (F.col("faculty") == F.col("code_faculty"))
    other = (F.col("campus") == "Other") & F.col("faculty").isNull() & F.col("department").isNull()
    by_code = courses.join(coded, "course_code").filter(unnamed | same | other).select("faculty_id", "course_id")
    return by_name.unionByName(by_code).distinct()


def course_faculty(t: Frames) -> DataFrame:
    """Faculty of every course: by names if both are given, else by course code."""
    named = t["faculties"].join(t["campuses"], "campus_id").select(
        "faculty", "campus", F.col("faculty_id").alias("named_faculty_id")
    )
    coded = t["faculty_course_codes"].select("course_code", F.col("faculty_id").alias("coded_faculty_id"))
    given = F.col("campus").isNotNull() & F.col("faculty").isNotNull()
    return (
        t["courses"].select("course_id", "course_code", "campus", "faculty")
        .join(named, ["faculty", "campus"], "left")
        .join(coded, "course_code", "left")
        .select("course_id",
                F.when(given, F.col("named_faculty_id")).otherwise(F.col("coded_faculty_id")).alias("faculty_id"))
    )
