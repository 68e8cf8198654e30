"""Coverage, completeness and frequency reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mapwise.functions import rules
from mapwise.operators.maps import mapped_pairs
from mapwise.operators.programs import Frames, with_scopes
from mapwise.plans.skew import fan_out_join


def unaligned_clos(t: Frames) -> DataFrame:
    """Course outcomes without an assessment link or without an activity link."""
    assessed = t["outcome_assessments"].select("l_outcome_id", F.lit(True).alias("assessed")).distinct()
    active = t["outcome_activities"].select("l_outcome_id", F.lit(True).alias("active")).distinct()
    return (
        t["learning_outcomes"].select("course_id", "l_outcome_id")
        .join(assessed, "l_outcome_id", "left").join(active, "l_outcome_id", "left")
        .select("course_id", "l_outcome_id",
                F.coalesce("assessed", F.lit(False)).alias("has_assessment"),
                F.coalesce("active", F.lit(False)).alias("has_activity"))
        .filter(~(F.col("has_assessment") & F.col("has_activity")))
    )


def alignment(t: Frames) -> DataFrame:
    """Methods and activities each course outcome is aligned with, one row per link."""
    clos = t["learning_outcomes"].select("l_outcome_id", "course_id", "l_outcome")
    methods = t["outcome_assessments"].join(
        t["assessment_methods"].select("a_method_id", F.col("a_method").alias("item")), "a_method_id"
    ).select("l_outcome_id", F.lit("assessment").alias("kind"), F.col("a_method_id").alias("item_id"), "item")
    activities = t["outcome_activities"].join(
        t["learning_activities"].select("l_activity_id", F.col("l_activity").alias("item")), "l_activity_id"
    ).select("l_outcome_id", F.lit("activity").alias("kind"), F.col("l_activity_id").alias("item_id"), "item")
    return clos.join(methods.unionByName(activities), "l_outcome_id").select(
        "course_id", "l_outcome_id", "l_outcome", "kind", "item_id", "item"
    )


def course_standards(t: Frames) -> DataFrame:
    """Each course against the standards of its category; a missing mapping leaves the scale null."""
    maps = t["standards_outcome_maps"].join(
        t["standard_scales"].select("standard_scale_id", F.col("abbreviation").alias("scale")),
        "standard_scale_id", "left",
    )
    grid = fan_out_join(
        t["courses"].select("course_id", "standard_category_id"),
        t["standards"].select("standard_category_id", "standard_id", "s_shortphrase"),
        ["standard_category_id"],
    )
    return grid.join(maps, ["course_id", "standard_id"], "left").select(
        "course_id", "standard_id", "s_shortphrase", "standard_scale_id", "scale"
    )


def _title_frequency(t: Frames, items: DataFrame, title: str) -> DataFrame:
    """Titles counted per course first, so scopes and programs multiply counts instead of rows."""
    per_course = items.groupBy("course_id", rules.capitalise_words(F.col(title)).alias(title)).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        with_scopes(t).join(per_course, "course_id").groupBy("program_id", "scope", title)
        .agg(F.sum("n").alias("n"))
    )


def merge_finals(counts: DataFrame) -> DataFrame:
    """'Final' counts as 'Final Exam' in a program and scope that has both."""
    exams = counts.filter(F.col("a_method") == "Final Exam").select(
        "program_id", "scope", F.lit(True).alias("has_exam")
    )
    title = F.when((F.col("a_method") == "Final") & F.coalesce("has_exam", F.lit(False)), "Final Exam")
    return (
        counts.join(exams, ["program_id", "scope"], "left")
        .groupBy("program_id", "scope", title.otherwise(F.col("a_method")).alias("a_method"))
        .agg(F.sum("n").alias("n"))
    )


def assessment_frequency(t: Frames) -> DataFrame:
    return merge_finals(_title_frequency(t, t["assessment_methods"], "a_method"))


def activity_frequency(t: Frames) -> DataFrame:
    return _title_frequency(t, t["learning_activities"], "l_activity")


def priority_frequency(t: Frames) -> DataFrame:
    """Courses addressing each strategic priority per program and scope."""
    counts = (
        with_scopes(t).join(t["course_optional_priorities"].distinct(), "course_id")
        .groupBy("program_id", "scope", "op_id").agg(F.count(F.lit(1)).alias("n_courses"))
    )
    return (
        counts.join(t["optional_priorities"], "op_id")
        .join(t["optional_priority_subcategories"], "subcat_id", "left")
        .select("program_id", "scope", "subcat_id", "subcat_name", "op_id", "optional_priority", "n_courses")
    )


def priority_courses(t: Frames) -> DataFrame:
    """The course list behind ``priority_frequency``, one row per course."""
    return (
        with_scopes(t).join(t["course_optional_priorities"].distinct(), "course_id")
        .join(t["courses"].select("course_id", "course_code", "course_num"), "course_id")
        .select("program_id", "scope", "op_id", "course_id", "course_code", "course_num")
    )


def standards_coverage_courses(t: Frames) -> DataFrame:
    """(program, standard, scale, course) for the courses that belong to the program level's category.

    Only courses with some mapping count; a standard such a course does not map is N/A.
    """
    level = t["programs"].select(
        "program_id", rules.standards_category(F.col("level")).alias("standard_category_id")
    )
    mapped = t["standards_outcome_maps"].select("course_id").distinct()
    courses = (
        t["course_programs"].select("program_id", "course_id").join(level, "program_id")
        .join(t["courses"].select("course_id", "standard_category_id"), ["course_id", "standard_category_id"])
        .join(mapped, "course_id")
    )
    grid = fan_out_join(courses, t["standards"].select("standard_category_id", "standard_id"), ["standard_category_id"])
    return grid.join(t["standards_outcome_maps"], ["course_id", "standard_id"], "left").select(
        "program_id", "standard_id",
        F.coalesce("standard_scale_id", F.lit(rules.NOT_APPLICABLE).cast("long")).alias("standard_scale_id"),
        "course_id",
    )


def standards_coverage(t: Frames) -> DataFrame:
    """Course counts per (program, standard, scale) with zeros."""
    # The level list itself (those of scale category 1 and N/A), not data: attached to each standard as an array.
    levels = t["standard_scales"].filter(
        (F.col("scale_category_id") == 1) | (F.col("standard_scale_id") == rules.NOT_APPLICABLE)
    ).agg(F.collect_list(F.struct("standard_scale_id", F.col("title").alias("scale"), "colour")))
    rows = t["standards"].select(
        "standard_category_id", "standard_id", "s_shortphrase", F.inline(levels.scalar())
    )
    level = t["programs"].select(
        "program_id", rules.standards_category(F.col("level")).alias("standard_category_id")
    )
    grid = fan_out_join(level, rows, ["standard_category_id"])
    counts = (
        standards_coverage_courses(t).groupBy("program_id", "standard_id", "standard_scale_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return grid.join(counts, ["program_id", "standard_id", "standard_scale_id"], "left").select(
        "program_id", "standard_id", "s_shortphrase", "standard_scale_id", "scale",
        rules.series_colour(F.col("colour")).alias("colour"), F.coalesce("n", F.lit(0)).alias("n_courses"),
    )


def _clo_counts(t: Frames) -> DataFrame:
    return t["learning_outcomes"].groupBy("course_id").agg(F.count(F.lit(1)).alias("n_clos"))


def mapping_completeness(t: Frames) -> DataFrame:
    """Expected and actual mapped pairs per (program, course) and whether the program has gaps."""
    plos = t["program_learning_outcomes"].groupBy("program_id").agg(F.count(F.lit(1)).alias("n_plos"))
    actual = (
        mapped_pairs(t).select("program_id", "course_id", "l_outcome_id", "pl_outcome_id").distinct()
        .groupBy("program_id", "course_id").agg(F.count(F.lit(1)).alias("actual"))
    )
    rows = (
        t["course_programs"].select("program_id", "course_id")
        .join(plos, "program_id", "left").join(_clo_counts(t), "course_id", "left")
        .join(actual, ["program_id", "course_id"], "left")
        .select(
            "program_id", "course_id",
            (F.coalesce("n_plos", F.lit(0)) * F.greatest(F.coalesce("n_clos", F.lit(0)), F.lit(1))).alias("expected"),
            F.coalesce("actual", F.lit(0)).alias("actual"),
        )
    )
    gaps = rows.groupBy("program_id").agg(
        F.bool_or(F.col("expected") != F.col("actual")).alias("program_has_unmapped")
    )
    return rows.join(gaps, "program_id").select(
        "program_id", "course_id", "expected", "actual",
        (F.col("expected") == F.col("actual")).alias("is_complete"), "program_has_unmapped",
    )


def course_mapped_flag(t: Frames) -> DataFrame:
    """'Yes' when every outcome of the course is mapped to some outcome of the program."""
    mapped = (
        mapped_pairs(t).select("program_id", "course_id", "l_outcome_id").distinct()
        .groupBy("program_id", "course_id").agg(F.count(F.lit(1)).alias("n_mapped"))
    )
    done = (F.col("n_clos") > 0) & (F.col("n_clos") == F.col("n_mapped"))
    return (
        t["course_programs"].select("program_id", "course_id").join(_clo_counts(t), "course_id", "left")
        .join(mapped, ["program_id", "course_id"], "left")
        .select("program_id", "course_id", F.when(F.coalesce(done, F.lit(False)), "Yes").otherwise("No").alias("mapped"))
    )


# The open-step texts of the progress report.
STEP_TEXTS = {
    "description": "Course Description (Step 1)",
    "topics": "Course Topics (Step 2)",
    "materials": "Course Materials (Step 3)",
    "outcomes": "Course Learning Outcomes (Step 4)",
    "assessments": "Student Assessment Methods (Step 5)",
    "activities": "Teaching and Learning Activities (Step 6)",
    "align_assessments": "Assessment Methods - Course Alignment (Step 7)",
    "align_activities": "Learning Activities - Course Alignment (Step 7)",
    "align": "Course Alignment (Step 7)",
    "mapping": "Program Outcome Mapping (Step 8)",
    "standards": "Standards (Step 9)",
}


def course_progress(t: Frames) -> DataFrame:
    """Completion percent over ten steps (nine without standards) and the open steps of every course.

    Every counter is aggregated to course grain before the joins, so nothing multiplies. Alignment is worth
    two steps: none when no link exists, one while some outcome lacks a link, two when all have both.
    """
    def counter(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("course_id").agg(F.count(F.lit(1)).alias(name))

    clos = t["learning_outcomes"].select("l_outcome_id", F.col("course_id").alias("clo_course_id"))
    described = t["course_description"].groupBy("course_id").agg(
        F.bool_or(F.length("description") > 0).alias("described")
    )
    linked_methods = (
        t["outcome_assessments"].join(clos, "l_outcome_id")
        .join(t["assessment_methods"].select("a_method_id", "course_id"), "a_method_id")
    )
    linked_activities = (
        t["outcome_activities"].join(clos, "l_outcome_id")
        .join(t["learning_activities"].select("l_activity_id", "course_id"), "l_activity_id")
    )
    plos = t["program_learning_outcomes"].groupBy("program_id").agg(F.count(F.lit(1)).alias("n_plos"))
    programs = t["course_programs"].join(plos, "program_id", "left").groupBy("course_id").agg(
        F.count(F.lit(1)).alias("n_programs"), F.sum(F.coalesce("n_plos", F.lit(0))).alias("n_plos")
    )
    maps = counter(
        t["outcome_maps"].join(t["program_learning_outcomes"].select("pl_outcome_id"), "pl_outcome_id")
        .join(t["learning_outcomes"].select("l_outcome_id", "course_id"), "l_outcome_id"), "n_maps",
    )
    standards = t["standards"].groupBy("standard_category_id").agg(F.count(F.lit(1)).alias("n_standards"))
    counters = [
        counter(t["course_topics"], "n_topics"), counter(t["course_materials"], "n_materials"),
        _clo_counts(t), counter(t["assessment_methods"], "n_methods"),
        counter(t["learning_activities"], "n_activities"), counter(linked_methods, "n_linked_methods"),
        counter(linked_activities, "n_linked_activities"), counter(unaligned_clos(t), "n_unaligned"),
        programs, maps, counter(t["standards_outcome_maps"], "n_standard_maps"),
    ]
    rows = t["courses"].select("course_id", "standard_category_id").join(described, "course_id", "left")
    for c in counters:
        rows = rows.join(c, "course_id", "left")
    rows = rows.join(standards, "standard_category_id", "left").na.fill(0).na.fill(False)

    flag = lambda c: c.cast("long")
    expected = F.when(F.col("n_programs") <= 1, 1).otherwise(0) + F.col("n_plos") * F.col("n_clos")
    rows = rows.withColumn("expected", expected)
    unlinked = (F.col("n_linked_methods") == 0) & (F.col("n_linked_activities") == 0)
    steps = {
        "description": F.col("described"),
        "topics": F.col("n_topics") > 0,
        "materials": F.col("n_materials") > 0,
        "outcomes": F.col("n_clos") > 0,
        "assessments": F.col("n_methods") > 0,
        "activities": F.col("n_activities") > 0,
        "mapping": F.col("n_maps") >= F.when(F.col("expected") == 1, F.lit(1)).otherwise(F.col("expected") - 1),
    }
    alignment_steps = F.when(unlinked, 0).when(F.col("n_unaligned") > 0, 1).otherwise(2)
    has_standards = F.col("standard_category_id") != 0
    standards_done = has_standards & (F.col("n_standard_maps") == F.col("n_standards"))
    done = alignment_steps + flag(standards_done)
    for test in steps.values():
        done = done + flag(test)
    total = F.when(has_standards, 10).otherwise(9)
    open_tests = {
        **{name: ~test for name, test in steps.items()},
        "align_assessments": unlinked,
        "align_activities": unlinked,
        "align": ~unlinked & (F.col("n_unaligned") > 0),
        "standards": has_standards & ~standards_done,
    }
    open_steps = F.array_compact(F.array(*[F.when(open_tests[k], F.lit(v)) for k, v in STEP_TEXTS.items()]))
    return rows.select(
        "course_id", done.cast("long").alias("steps_done"), total.cast("long").alias("steps_total"),
        F.round(done / total * 100).cast("long").alias("percent"),
        F.array_join(open_steps, "; ").alias("open_steps"),
    )


def assessment_weight_total(t: Frames) -> DataFrame:
    return t["assessment_methods"].groupBy("course_id").agg(F.sum("weight").alias("total_weight"))


def category_stats(t: Frames) -> DataFrame:
    """PLOs per category (null = uncategorised) with the program's category totals."""
    per_category = t["program_learning_outcomes"].groupBy("program_id", "plo_category_id").agg(
        F.count(F.lit(1)).alias("n_plos")
    )
    totals = per_category.groupBy("program_id").agg(
        F.count("plo_category_id").alias("n_categories_used"),
        F.sum(F.when(F.col("plo_category_id").isNull(), F.col("n_plos")).otherwise(0)).alias("n_uncategorised"),
    )
    return per_category.join(totals, "program_id").select(
        "program_id", "plo_category_id", "n_plos", "n_categories_used", "n_uncategorised",
        (F.col("n_uncategorised") > 0).alias("has_uncategorised"),
    )
