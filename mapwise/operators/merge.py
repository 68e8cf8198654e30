"""Bulk maintenance of the mapping tables. Every function returns the new state of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mapwise.operators.programs import Frames
from mapwise.plans.numbering import number_rows


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace all base rows of the same key; incoming rows must be distinct."""
    return base.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming.select(*base.columns))


def replace_pairs(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace-set: the scales of each incoming pair are exactly the incoming ones."""
    return upsert(base, incoming.distinct(), ["l_outcome_id", "pl_outcome_id"])


def new_ids(rows: DataFrame, key: str, whole: DataFrame, name: str) -> DataFrame:
    """(key, name): fresh ids above the table's highest, in key order, numbered without a global sort."""
    highest = whole.agg(F.max(key)).scalar()
    numbered = number_rows(rows.select(key), [], [F.col(key)], F.floor(F.col(key) / 65536), "_n")
    return numbered.select(key, (F.col("_n") + highest).alias(name))


def duplicate_courses(t: Frames, ids: DataFrame) -> dict[str, DataFrame]:
    """Copies of the courses in ``ids`` with methods, activities, outcomes, their alignment and priorities.

    Old→new id tables are joined per child table; a link is copied when both its ends are.
    """
    course = new_ids(ids, "course_id", t["courses"], "new_course_id")

    def child(table: str, key: str) -> DataFrame:
        rows = t[table].join(course, "course_id")
        fresh = new_ids(rows, key, t[table], "new_id")
        return rows.join(fresh, key)

    methods, activities, clos = (
        child("assessment_methods", "a_method_id"), child("learning_activities", "l_activity_id"),
        child("learning_outcomes", "l_outcome_id"),
    )
    old_clo = clos.select("l_outcome_id", F.col("new_id").alias("new_l_outcome_id"))
    return {
        "courses": t["courses"].join(course, "course_id").withColumn("course_id", F.col("new_course_id")).drop("new_course_id"),
        "assessment_methods": methods.select(F.col("new_id").alias("a_method_id"), F.col("new_course_id").alias("course_id"), "a_method", "weight"),
        "learning_activities": activities.select(F.col("new_id").alias("l_activity_id"), F.col("new_course_id").alias("course_id"), "l_activity"),
        "learning_outcomes": clos.select(F.col("new_id").alias("l_outcome_id"), F.col("new_course_id").alias("course_id"), "l_outcome", "clo_shortphrase"),
        "outcome_assessments": t["outcome_assessments"].join(old_clo, "l_outcome_id")
        .join(methods.select("a_method_id", "new_id"), "a_method_id")
        .select(F.col("new_l_outcome_id").alias("l_outcome_id"), F.col("new_id").alias("a_method_id")),
        "outcome_activities": t["outcome_activities"].join(old_clo, "l_outcome_id")
        .join(activities.select("l_activity_id", "new_id"), "l_activity_id")
        .select(F.col("new_l_outcome_id").alias("l_outcome_id"), F.col("new_id").alias("l_activity_id")),
        "course_optional_priorities": t["course_optional_priorities"].join(course, "course_id")
        .select("op_id", F.col("new_course_id").alias("course_id")),
    }


def duplicate_programs(t: Frames, ids: DataFrame) -> dict[str, DataFrame]:
    """Copies of programs with categories, outcomes and scales; custom scales are copied, shared ones reused."""
    program = new_ids(ids, "program_id", t["programs"], "new_program_id")
    categories = t["p_l_o_categories"].join(program, "program_id")
    categories = categories.join(new_ids(categories, "plo_category_id", t["p_l_o_categories"], "new_category_id"), "plo_category_id")
    plos = t["program_learning_outcomes"].join(program, "program_id")
    plos = plos.join(new_ids(plos, "pl_outcome_id", t["program_learning_outcomes"], "new_id"), "pl_outcome_id")
    links = t["mapping_scale_programs"].join(program, "program_id").join(t["mapping_scales"], "map_scale_id")
    custom = links.filter(F.col("mapping_scale_categories_id").isNull())
    # One new scale per copied link: two programs sharing a custom scale get one copy each.
    highest = t["mapping_scales"].agg(F.max("map_scale_id")).scalar()
    custom = number_rows(
        custom, [], [F.col("program_id"), F.col("map_scale_id")], F.floor(F.col("program_id") / 4096), "_n"
    ).withColumn("new_scale_id", F.col("_n") + highest)
    shared = links.filter(F.col("mapping_scale_categories_id").isNotNull())
    return {
        "programs": t["programs"].join(program, "program_id").withColumn("program_id", F.col("new_program_id")).drop("new_program_id"),
        "p_l_o_categories": categories.select(F.col("new_category_id").alias("plo_category_id"), F.col("new_program_id").alias("program_id"), "plo_category"),
        "program_learning_outcomes": plos.join(categories.select("plo_category_id", "new_category_id"), "plo_category_id", "left")
        .select(F.col("new_id").alias("pl_outcome_id"), "pl_outcome", "plo_shortphrase",
                F.col("new_program_id").alias("program_id"), F.col("new_category_id").alias("plo_category_id")),
        "mapping_scales": custom.select(F.col("new_scale_id").alias("map_scale_id"), "title", "abbreviation", "colour", "mapping_scale_categories_id"),
        "mapping_scale_programs": custom.select(F.col("new_program_id").alias("program_id"), F.col("new_scale_id").alias("map_scale_id"))
        .unionByName(shared.select(F.col("new_program_id").alias("program_id"), "map_scale_id")),
    }


def detach(t: Frames, links: DataFrame) -> dict[str, DataFrame]:
    """Drop (course, program) links together with the maps of their pairs."""
    gone = links.select("course_id", "program_id").distinct()
    pairs = (
        t["outcome_maps"].select("l_outcome_id", "pl_outcome_id").distinct()
        .join(t["learning_outcomes"].select("l_outcome_id", "course_id"), "l_outcome_id")
        .join(t["program_learning_outcomes"].select("pl_outcome_id", "program_id"), "pl_outcome_id")
        .join(gone, ["course_id", "program_id"], "left_semi").select("l_outcome_id", "pl_outcome_id")
    )
    return {
        "course_programs": t["course_programs"].join(gone, ["course_id", "program_id"], "left_anti"),
        "outcome_maps": t["outcome_maps"].join(pairs, ["l_outcome_id", "pl_outcome_id"], "left_anti"),
    }


def reset_scale_family(t: Frames, assignments: DataFrame) -> dict[str, DataFrame]:
    """Give programs a default scale family: their maps and family scales go, custom scales stay.

    ``assignments``: (program_id, mapping_scale_categories_id).
    """
    programs = assignments.select("program_id").distinct()
    plos = t["program_learning_outcomes"].join(programs, "program_id", "left_semi").select("pl_outcome_id")
    family = t["mapping_scales"].select("map_scale_id", "mapping_scale_categories_id")
    old = (
        t["mapping_scale_programs"].join(programs, "program_id", "left_semi").join(family, "map_scale_id")
        .filter(F.col("mapping_scale_categories_id").isNotNull()).select("program_id", "map_scale_id")
    )
    new = assignments.join(family, "mapping_scale_categories_id").select("program_id", "map_scale_id")
    touched = programs.withColumn("_reset", F.lit(True))
    return {
        "outcome_maps": t["outcome_maps"].join(plos, "pl_outcome_id", "left_anti"),
        "mapping_scale_programs": t["mapping_scale_programs"].join(old, ["program_id", "map_scale_id"], "left_anti")
        .unionByName(new).distinct(),
        "course_programs": t["course_programs"].join(touched, "program_id", "left").select(
            "course_id", "program_id", "course_required",
            F.when(F.col("_reset"), 0).otherwise(F.col("map_status")).cast("long").alias("map_status"),
        ),
    }


def backfill_scale_id(maps: DataFrame, scales: DataFrame, label: str, scale_id: str) -> DataFrame:
    """Scale ids from legacy label texts: lowest id of the label; unknown labels keep what they have."""
    lookup = scales.groupBy(F.col("abbreviation").alias(label)).agg(F.min(scale_id).alias("_found"))
    return maps.join(lookup, label, "left").withColumn(scale_id, F.coalesce("_found", scale_id)).select(*maps.columns)


def split_legacy_program(legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(categories, links): program ids 1-3 were standards categories, all others real programs."""
    is_category = F.col("program_id").between(1, 3)
    return (
        legacy.filter(is_category).select("course_id", F.col("program_id").alias("standard_category_id")),
        legacy.filter(~is_category).select("course_id", "program_id"),
    )


def match_legacy_priorities(legacy: DataFrame, priorities: DataFrame) -> DataFrame:
    """Ids of legacy priority texts (lowest per text); texts without one are flagged."""
    lookup = priorities.groupBy(F.col("optional_priority").alias("priority_text")).agg(F.min("op_id").alias("op_id"))
    return legacy.join(lookup, "priority_text", "left").select(
        "course_id", "priority_text", "op_id", F.col("op_id").isNull().alias("unmatched")
    )


SECTIONS = ("outcomes", "methods", "activities", "alignment", "program_maps")


def course_bundles(t: Frames, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """One record per item of the chosen sections of every course: (course, section, item id, JSON).

    The bundle of a course is the set of its records; writing it partitioned by course gives one folder each,
    and no course, however large, has to fit in one value.
    """
    def record(df: DataFrame, section: str, item_id: str, *fields: str) -> DataFrame:
        return df.select(
            "course_id", F.lit(section).alias("section"), F.col(item_id).cast("string").alias("item_id"),
            F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item"),
        )

    from mapwise.operators.coverage import alignment
    from mapwise.operators.maps import resolved_maps

    builders = {
        "outcomes": lambda: record(t["learning_outcomes"], "outcomes", "l_outcome_id", "l_outcome", "clo_shortphrase"),
        "methods": lambda: record(t["assessment_methods"], "methods", "a_method_id", "a_method", "weight"),
        "activities": lambda: record(t["learning_activities"], "activities", "l_activity_id", "l_activity"),
        "alignment": lambda: record(alignment(t), "alignment", "l_outcome_id", "kind", "item_id", "item"),
        "program_maps": lambda: record(resolved_maps(t), "program_maps", "l_outcome_id", "program_id", "pl_outcome_id", "abbreviation"),
    }
    result = None
    for name in sections:
        part = builders[name]()
        result = part if result is None else result.unionByName(part)
    return result
