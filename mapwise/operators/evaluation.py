"""Scoring predicted labels against a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mapwise.functions import rules
from mapwise.plans.numbering import number_rows

# The levels labels may name.
LABELS = ["I", "R", "E"]


def _draw(seed: int) -> Column:
    """A repeatable random key per id, the same in every run and on every partitioning."""
    return F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))


def undersample(df: DataFrame, seed: int) -> DataFrame:
    """All positives and exactly as many negatives, drawn by hash order.

    Negatives are numbered in 65,536 hash buckets, so no global sort or limit meets in one task.
    """
    positives = df.filter(F.col("score") == 1)
    negatives = number_rows(
        df.filter(F.col("score") == 0).withColumn("_draw", _draw(seed)), [], [F.col("_draw"), F.col("id")],
        F.substring("_draw", 1, 4), "_position",
    )
    wanted = positives.agg(F.count(F.lit(1))).scalar()
    return positives.unionByName(negatives.filter(F.col("_position") <= wanted).select(*df.columns))


def split_sets(df: DataFrame, seed: int) -> DataFrame:
    """80/10/10 by hash: a row keeps its set whatever else is in the data."""
    tenth = F.conv(F.substring(_draw(seed), 1, 8), 16, 10).cast("long") % 10
    return df.withColumn("split", F.when(tenth < 8, "train").when(tenth == 8, "eval").otherwise("test"))


def attach_predictions(df: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers per (run, id) attached to every labelled row; no answer or no label means prediction 0.

    ``answers`` has run_id, id, position and map_labels (array); of repeated answers the one at the last position
    counts. The run names, one per model and prompt variant, are a short list; each run scores the whole labelled set.
    """
    runs = answers.agg(F.sort_array(F.collect_set("run_id"))).scalar()
    rows = df.withColumn("run_id", F.explode(runs))
    last = F.max(F.struct("position", "map_labels"))["map_labels"]
    final = answers.groupBy("run_id", "id").agg(last.alias("map_labels"))
    labels = F.coalesce("map_labels", F.array().cast("array<string>"))
    return rows.join(final, ["run_id", "id"], "left").withColumn("map_labels", labels).withColumn(
        "pred_score", (F.size("map_labels") > 0).cast("long")
    )


def _truth() -> Column:
    return F.array_compact(F.array("i_label", "r_label", "e_label"))


def _predicted(allowed: list[str]) -> Column:
    return rules.label_set(F.col("map_labels"), allowed)


def _binary() -> list[Column]:
    score, pred = F.col("score") == 1, F.col("pred_score") == 1
    return [
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("score") == F.col("pred_score")).cast("double")), 6).alias("accuracy"),
        F.count_if(~score & pred).alias("new_match"),
        F.count_if(score & ~pred).alias("missed_match"),
        F.count_if(score & pred).alias("match_score_1"),
        F.count_if(~score & ~pred).alias("match_score_0"),
    ]


def binary_metrics(scored: DataFrame) -> DataFrame:
    return scored.groupBy("run_id").agg(*_binary())


def _labelled(scored: DataFrame, allowed: list[str]) -> DataFrame:
    rows = scored.withColumn("_true", _truth()).withColumn("_pred", _predicted(allowed))
    n_true, n_pred = F.size("_true"), F.size("_pred")
    covered = F.size(F.array_except("_true", "_pred")) == 0
    kind = (
        F.when((n_pred == 0) != (n_true == 0), "none").when(covered, "full")
        .when(F.arrays_overlap("_true", "_pred"), "partial").otherwise("none")
    )
    return rows.withColumn("_kind", kind).withColumn("_new", F.size(F.array_except("_pred", "_true")) > 0)


def _label_counts() -> list[Column]:
    n = F.count(F.lit(1))
    return [
        F.count_if(F.col("_kind") == "full").alias("full_match"),
        F.count_if(F.col("_kind") == "partial").alias("partial_match"),
        F.count_if(F.col("_kind") == "none").alias("no_match"),
        F.round(F.count_if(F.col("_kind") != "none") / n, 4).alias("at_least_one_accuracy"),
        F.round(F.count_if("_new") / n, 4).alias("new_label_share"),
    ]


def label_match(scored: DataFrame, allowed: list[str] = LABELS) -> DataFrame:
    """Full, partial and no matches of label sets per run."""
    return _labelled(scored, allowed).groupBy("run_id").agg(*_label_counts())


def _hamming(allowed: list[str]) -> tuple[list[Column], Column]:
    """Per label: rows that differ and whether the truth ever has it; then loss over the labels it has."""
    aggregates, wrong, classes = [], F.lit(0), F.lit(0)
    for label in allowed:
        is_true, is_pred = F.array_contains("_true", label), F.array_contains("_pred", label)
        aggregates += [F.count_if(is_true != is_pred).alias(f"_wrong_{label}"), F.bool_or(is_true).alias(f"_has_{label}")]
        present = F.col(f"_has_{label}").cast("long")
        wrong, classes = wrong + F.col(f"_wrong_{label}") * present, classes + present
    loss = F.round(F.try_divide(wrong.cast("double"), (F.col("n") * classes).cast("double")), 6)
    return aggregates, loss


def hamming(scored: DataFrame, allowed: list[str] = LABELS) -> DataFrame:
    """Hamming loss over label indicators; classes are the labels the truth holds."""
    aggregates, loss = _hamming(allowed)
    return _labelled(scored, allowed).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *aggregates).select(
        "run_id", loss.alias("hamming_loss")
    )


def run_comparison(scored: DataFrame, allowed: list[str] = LABELS) -> DataFrame:
    """All scores, one row per run, in one aggregation."""
    aggregates, loss = _hamming(allowed)
    table = _labelled(scored, allowed).groupBy("run_id").agg(*_binary(), *_label_counts(), *aggregates)
    return table.withColumn("hamming_loss", loss).drop(*[c for c in table.columns if c.startswith("_")])
