"""Outcome maps: resolution, cell distributions, modal and dominant levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mapwise.functions import rules
from mapwise.operators.programs import Frames, with_scopes
from mapwise.plans.skew import fan_out_join

CELL = ["program_id", "pl_outcome_id", "course_id"]


def mapped_pairs(t: Frames, multi: str = "all") -> DataFrame:
    """Every mapped (CLO, PLO, scale id) of every program the course belongs to.

    ``multi='all'`` keeps each scale of a pair, ``'one'`` the lowest scale id.
    """
    maps = t["outcome_maps"]
    if multi == "one":
        maps = maps.groupBy("l_outcome_id", "pl_outcome_id").agg(F.min("map_scale_id").alias("map_scale_id"))
    return (
        maps.join(t["learning_outcomes"].select("l_outcome_id", "course_id"), "l_outcome_id")
        .join(t["program_learning_outcomes"].select("pl_outcome_id", "program_id"), "pl_outcome_id")
        .join(t["course_programs"].select("program_id", "course_id"), ["program_id", "course_id"])
    )


def resolved_maps(t: Frames, multi: str = "all") -> DataFrame:
    """``mapped_pairs`` with the scale's abbreviation."""
    return mapped_pairs(t, multi).join(t["mapping_scales"].select("map_scale_id", "abbreviation"), "map_scale_id").select(
        "program_id", "course_id", "l_outcome_id", "pl_outcome_id", "map_scale_id", "abbreviation"
    )


def _cell_scales(t: Frames) -> DataFrame:
    """Counts per cell and scale; scale rows and scopes are joined to the counts, not to the maps."""
    return mapped_pairs(t).groupBy(*CELL, "map_scale_id").agg(F.count(F.lit(1)).alias("n"))


def _scoped(t: Frames, cells: DataFrame) -> DataFrame:
    return cells.join(with_scopes(t), ["program_id", "course_id"])


def scale_frequency(t: Frames) -> DataFrame:
    """Scale counts per (program, scope, PLO, course)."""
    known = _cell_scales(t).join(t["mapping_scales"].select("map_scale_id"), "map_scale_id")
    return _scoped(t, known).select("program_id", "scope", "pl_outcome_id", "course_id", "map_scale_id", "n")


def modal_cells(t: Frames) -> DataFrame:
    """Most frequent scale per cell; ties joined by ' / ' in scale order and shown white."""
    return modal(_cell_scales(t), t["mapping_scales"])


def modal(counts: DataFrame, scales: DataFrame) -> DataFrame:
    """As ``modal_cells``, of counts per cell and scale.

    A cell gathers at most one entry per scale of the scale table, whatever the number of maps behind it.
    """
    counted = counts.join(scales.select("map_scale_id", "abbreviation", "colour"), "map_scale_id")
    entry = F.struct("map_scale_id", "abbreviation", "colour", "n")
    cells = counted.groupBy(*CELL).agg(F.max("n").alias("top"), F.sort_array(F.collect_list(entry)).alias("scales"))
    winners = F.filter("scales", lambda s: s["n"] == F.col("top"))
    cells = cells.withColumn("winners", winners)
    tie = F.size("winners") > 1
    colour = F.col("winners")[0]["colour"]
    return cells.select(
        *CELL,
        F.array_join(F.transform("winners", lambda s: s["abbreviation"]), " / ").alias("label"),
        tie.alias("is_tie"),
        F.when(tie | colour.isNull(), rules.WHITE).otherwise(colour).alias("colour"),
        F.col("top").alias("n"),
    )


def program_map(t: Frames) -> DataFrame:
    """The program map for every scope."""
    return scoped_map(t, modal_cells(t))


def scoped_map(t: Frames, cells: DataFrame) -> DataFrame:
    """Modal cells for every scope their course has in the program."""
    return _scoped(t, cells).select("program_id", "scope", "pl_outcome_id", "course_id", "label", "is_tie", "colour", "n")


def cell_frequencies(t: Frames) -> DataFrame:
    """Label counts per cell in one text 'A:2, N/A:1'; scales with equal labels merge."""
    counted = (
        _cell_scales(t).join(t["mapping_scales"].select("map_scale_id", "abbreviation"), "map_scale_id")
        .groupBy(*CELL, "abbreviation").agg(F.sum("n").alias("n"))
    )
    cells = counted.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("abbreviation", "n"))).alias("f"))
    text = F.array_join(
        F.transform("f", lambda e: F.concat(e["abbreviation"], F.lit(":"), e["n"].cast("string"))), ", "
    )
    return _scoped(t, cells.select(*CELL, text.alias("frequencies"))).select(
        "program_id", "scope", "pl_outcome_id", "course_id", "frequencies"
    )


def cell_frequency_maps(t: Frames) -> DataFrame:
    """As ``cell_frequencies`` with a map column, for consumers that stay in Spark."""
    return cell_frequencies(t).withColumn("frequencies", F.str_to_map("frequencies", F.lit(", "), F.lit(":")))


def dominant_cells(t: Frames) -> DataFrame:
    """Highest level reached per cell, by the order of the program's scale family.

    The family is the one of the lowest scale id the program maps with, N/A aside.
    """
    counted = _cell_scales(t).join(
        t["mapping_scales"].select("map_scale_id", "abbreviation", "mapping_scale_categories_id"), "map_scale_id"
    )
    family = counted.filter(F.col("map_scale_id") != rules.NOT_APPLICABLE).groupBy("program_id").agg(
        F.min_by("mapping_scale_categories_id", "map_scale_id").alias("family")
    )
    rank = rules.family_rank(F.col("family"), F.col("abbreviation"), F.col("map_scale_id"))
    return (
        counted.join(family, "program_id", "left")
        .groupBy(*CELL)
        .agg(F.max(F.struct(rank.alias("rank"), F.col("map_scale_id"), F.col("abbreviation"))).alias("best"))
        .select(*CELL, F.col("best.abbreviation").alias("label"), F.col("best.map_scale_id").alias("map_scale_id"))
    )


def plo_scale_matrix(t: Frames) -> DataFrame:
    """PLO × scale counts of every program with zeros, N/A as the last scale."""
    scales = t["mapping_scales"].select("map_scale_id", "title", "colour")
    used = t["mapping_scale_programs"].join(scales, "map_scale_id").withColumn("is_last", F.lit(False))
    programs = t["programs"].select("program_id", F.lit(rules.NOT_APPLICABLE).cast("long").alias("map_scale_id"))
    last = programs.join(scales, "map_scale_id").withColumn("is_last", F.lit(True))
    grid = fan_out_join(
        t["program_learning_outcomes"].select("program_id", "pl_outcome_id"), used.unionByName(last), ["program_id"]
    )
    counts = t["outcome_maps"].groupBy("pl_outcome_id", "map_scale_id").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["pl_outcome_id", "map_scale_id"], "left").select(
        "program_id", "pl_outcome_id", "map_scale_id", "title", "is_last",
        rules.series_colour(F.col("colour")).alias("colour"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def cell_outcome_text(t: Frames) -> DataFrame:
    """Course outcomes behind each cell, one row per outcome in id order; N/A does not count.

    Rows stay long: a cell may rest on any number of outcomes, so none is gathered into one value.
    """
    return (
        mapped_pairs(t).filter(F.col("map_scale_id") != rules.NOT_APPLICABLE)
        .select(*CELL, "l_outcome_id").distinct()
        .join(t["learning_outcomes"].select("l_outcome_id", "l_outcome"), "l_outcome_id")
        .select(*CELL, "l_outcome_id", "l_outcome")
    )


def pair_labels(t: Frames) -> DataFrame:
    """Label of every mapped pair; the scales of one pair joined by ' / '."""
    entry = F.struct("map_scale_id", "abbreviation")
    joined: Column = F.array_join(F.transform(F.sort_array(F.collect_set(entry)), lambda s: s["abbreviation"]), " / ")
    return (
        t["outcome_maps"].join(t["mapping_scales"].select("map_scale_id", "abbreviation"), "map_scale_id")
        .groupBy("l_outcome_id", "pl_outcome_id").agg(joined.alias("label"))
    )
