"""Report tables: dense grids and listings for all programs and courses, and recent work per user.

Grids are long; the wide sheet of one program is a pivot with a given value list at the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mapwise.functions import rules
from mapwise.operators.access import visible_entities
from mapwise.operators.coverage import course_mapped_flag
from mapwise.operators.maps import cell_outcome_text, dominant_cells, modal_cells, pair_labels
from mapwise.operators.programs import Frames, plo_labels
from mapwise.plans.skew import fan_out_join


def course_program_maps(t: Frames) -> DataFrame:
    """Each course's map for each of its programs: program × PLO × CLO → scale."""
    scales = t["mapping_scales"].select("map_scale_id", "abbreviation", F.col("title").alias("scale_title"))
    return (
        t["outcome_maps"]
        .join(t["learning_outcomes"].select("l_outcome_id", "course_id", "clo_shortphrase"), "l_outcome_id")
        .join(t["program_learning_outcomes"].select("pl_outcome_id", "program_id", "plo_shortphrase"), "pl_outcome_id")
        .join(t["course_programs"].select("program_id", "course_id"), ["program_id", "course_id"])
        .join(scales, "map_scale_id")
        .select("course_id", "program_id", "pl_outcome_id", "plo_shortphrase", "l_outcome_id", "clo_shortphrase",
                "map_scale_id", "abbreviation", "scale_title")
    )


def program_grid(t: Frames, value: str) -> DataFrame:
    """Every course × every PLO of each program; blank where unmapped.

    ``value``: 'modal' or 'dominant' label, or 'text' for the course outcomes behind the cell (one row each).
    """
    grid = fan_out_join(t["course_programs"].select("program_id", "course_id"), plo_labels(t), ["program_id"])
    if value == "text":
        cells = cell_outcome_text(t).withColumnRenamed("l_outcome", "value")
        extra = ["l_outcome_id"]
    else:
        cells = (modal_cells(t) if value == "modal" else dominant_cells(t)).withColumnRenamed("label", "value")
        extra = []
    keys = ["program_id", "pl_outcome_id", "course_id"]
    return grid.join(cells.select(*keys, *extra, "value"), keys, "left").select(
        "program_id", "course_id", "pl_outcome_id", "plo_category", "position",
        F.col("label").alias("plo_label"), *extra, F.coalesce("value", F.lit("")).alias("value"),
    )


def _program_clos(t: Frames) -> DataFrame:
    return t["course_programs"].select("program_id", "course_id").join(
        t["learning_outcomes"].select("l_outcome_id", "course_id"), "course_id"
    )


def outcome_grid(t: Frames) -> DataFrame:
    """Every CLO × every PLO of the program → label or blank."""
    plos = t["program_learning_outcomes"].select("program_id", "pl_outcome_id")
    grid = fan_out_join(_program_clos(t), plos, ["program_id"])
    return grid.join(pair_labels(t), ["l_outcome_id", "pl_outcome_id"], "left").select(
        "program_id", "course_id", "l_outcome_id", "pl_outcome_id", F.coalesce("label", F.lit("")).alias("label")
    )


def course_grid(t: Frames) -> DataFrame:
    """Every CLO of a course × every (program, category, PLO) of its programs → label or blank."""
    plos = t["program_learning_outcomes"].join(
        t["p_l_o_categories"].select("plo_category_id", "plo_category"), "plo_category_id", "left"
    ).select("program_id", F.coalesce("plo_category", F.lit("Uncategorized")).alias("plo_category"), "pl_outcome_id")
    grid = fan_out_join(_program_clos(t), plos, ["program_id"])
    return grid.join(pair_labels(t), ["l_outcome_id", "pl_outcome_id"], "left").select(
        "course_id", "program_id", "plo_category", "pl_outcome_id", "l_outcome_id",
        F.coalesce("label", F.lit("")).alias("label"),
    )


def _titles(t: Frames, kind: str) -> DataFrame:
    if kind == "assessment":
        return t["assessment_methods"].select("course_id", rules.capitalise_words(F.col("a_method")).alias("title"))
    if kind == "activity":
        return t["learning_activities"].select("course_id", rules.capitalise_words(F.col("l_activity")).alias("title"))
    return t["course_optional_priorities"].join(t["optional_priorities"], "op_id").select(
        "course_id", F.col("optional_priority").alias("title")
    )


def presence_grid(t: Frames, kind: str) -> DataFrame:
    """Every course × every distinct title used in the program → 1 or blank; equal titles are one column."""
    links = t["course_programs"].select("program_id", "course_id")
    has = _titles(t, kind).distinct()
    titles = links.join(has, "course_id").select("program_id", "title").distinct()
    marks = has.withColumn("mark", F.lit("1"))
    return fan_out_join(links, titles, ["program_id"]).join(marks, ["course_id", "title"], "left").select(
        "program_id", "course_id", "title", F.coalesce("mark", F.lit("")).alias("value")
    )


def alignment_grid(t: Frames, kind: str) -> DataFrame:
    """Every CLO × every method or activity of its course → 1 or blank."""
    if kind == "assessment":
        items = t["assessment_methods"].select("course_id", F.col("a_method_id").alias("item_id"), F.col("a_method").alias("item"))
        links = t["outcome_assessments"].select("l_outcome_id", F.col("a_method_id").alias("item_id"))
    else:
        items = t["learning_activities"].select("course_id", F.col("l_activity_id").alias("item_id"), F.col("l_activity").alias("item"))
        links = t["outcome_activities"].select("l_outcome_id", F.col("l_activity_id").alias("item_id"))
    clos = t["learning_outcomes"].select("course_id", "l_outcome_id")
    marks = links.distinct().withColumn("mark", F.lit("1"))
    return fan_out_join(clos, items, ["course_id"]).join(marks, ["l_outcome_id", "item_id"], "left").select(
        "course_id", "l_outcome_id", "item_id", "item", F.coalesce("mark", F.lit("")).alias("value")
    )


def program_listing(t: Frames) -> dict[str, DataFrame]:
    """The listing sheets of every program: outcomes by category, scales, facts, courses."""
    labels = plo_labels(t)
    outcomes = labels.join(t["program_learning_outcomes"].select("pl_outcome_id", "pl_outcome"), "pl_outcome_id")
    facts = t["program_learning_outcomes"].groupBy("program_id").agg(F.count(F.lit(1)).alias("n_plos"))
    n_courses = t["course_programs"].groupBy("program_id").agg(F.count(F.lit(1)).alias("n_courses"))
    return {
        "outcomes": outcomes.select(
            "program_id", F.coalesce("plo_category", F.lit("Uncategorized")).alias("plo_category"),
            "position", "pl_outcome_id", "label", "pl_outcome",
        ),
        "scales": t["mapping_scale_programs"].join(t["mapping_scales"], "map_scale_id").select(
            "program_id", "map_scale_id", "abbreviation", "title", "colour"
        ),
        "info": t["programs"].join(facts, "program_id", "left").join(n_courses, "program_id", "left").select(
            "program_id", "program", "level", "campus", "faculty", "department",
            F.coalesce("n_plos", F.lit(0)).alias("n_plos"), F.coalesce("n_courses", F.lit(0)).alias("n_courses"),
        ),
        "courses": t["course_programs"].join(
            t["courses"].select("course_id", "course_code", "course_num", "course_title"), "course_id"
        ).join(course_mapped_flag(t), ["program_id", "course_id"]).select(
            "program_id", "course_id", "course_code", "course_num", "course_title",
            F.when(F.col("course_required") == 1, "Yes").otherwise("No").alias("required"), "mapped",
        ),
    }


def course_listing(t: Frames) -> dict[str, DataFrame]:
    """The listing sheets of every course: outcomes of its programs, scales, standards with their level."""
    links = t["course_programs"].select("course_id", "program_id")
    plos = t["program_learning_outcomes"].join(
        t["p_l_o_categories"].select("plo_category_id", "plo_category"), "plo_category_id", "left"
    ).select("program_id", "pl_outcome_id", "pl_outcome",
             F.coalesce("plo_category", F.lit("Uncategorized")).alias("plo_category"))
    scales = t["mapping_scale_programs"].join(t["mapping_scales"], "map_scale_id").select(
        "program_id", "map_scale_id", "abbreviation", "title"
    )
    standards = (
        t["standards_outcome_maps"].join(t["standards"].select("standard_id", "s_shortphrase"), "standard_id")
        .join(t["standard_scales"].select("standard_scale_id", F.col("title").alias("scale")), "standard_scale_id")
    )
    return {
        "outcomes": fan_out_join(links, plos, ["program_id"]),
        "scales": fan_out_join(links, scales, ["program_id"]),
        "standards": standards.select("course_id", "standard_id", "s_shortphrase", "scale"),
    }


def recent_entities(t: Frames, k: int, now: str) -> DataFrame:
    """The k last updated courses, programs and syllabi of every user with an age phrase.

    Scopes open their k newest entities only, so a role brings a user k rows for each scope, not all that it opens. The rank
    filter becomes a per-task limit before the exchange.
    """
    def named(table: str, entity: str, key: str, title: str) -> DataFrame:
        return t[table].select(F.lit(entity).alias("entity"), F.col(key).alias("entity_id"),
                               F.col(title).alias("title"), "updated_at")

    titles = named("courses", "course", "course_id", "course_title").unionByName(
        named("programs", "program", "program_id", "program")
    )
    syllabi = t["syllabi"].select(F.lit("syllabus").alias("entity"), F.col("syllabus_id").alias("entity_id"),
                                  "user_id", "title", "updated_at")
    dated = visible_entities(t, titles, k).join(titles, ["entity", "entity_id"]).unionByName(syllabi)
    newest = Window.partitionBy("entity", "user_id").orderBy(F.col("updated_at").desc_nulls_last(), "entity_id")
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at")
    return (
        dated.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= k)
        .select("entity", "user_id", F.col("position").cast("long").alias("position"), "entity_id", "title",
                rules.age_phrase(seconds).alias("age"))
    )
