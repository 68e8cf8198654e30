"""Program map kept up from a change feed: signed row changes against stored counts per cell and scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from mapwise.operators.grant_support import signed_difference
from mapwise.operators.maps import CELL, modal
from mapwise.operators.programs import Frames

#: Parts by hash of (program, course); a change reads and rewrites the parts that it touches, so a busy program is split.
BUCKETS = 64
MAP, MEMBER = ["l_outcome_id", "pl_outcome_id", "map_scale_id"], ["program_id", "course_id"]
_LINKS = "program_id bigint, pl_outcome_id bigint, course_id bigint, map_scale_id bigint, n bigint"
_MEMBERS = "program_id bigint, course_id bigint, n bigint"
_MODES = "program_id bigint, pl_outcome_id bigint, course_id bigint, label string, is_tie boolean, colour string, n bigint"
_SCHEMAS = {"links": _LINKS, "members": _MEMBERS, "modes": _MODES}
_KEYS = {"links": [*CELL, "map_scale_id"], "members": MEMBER}


def first_rows(t: Frames) -> tuple[DataFrame, DataFrame]:
    """The whole tables as changes for the first batch: all maps and all courses of programs come."""
    return (t["outcome_maps"].select(*MAP).withColumn("sign", F.lit(1)),
            t["course_programs"].select(*MEMBER).withColumn("sign", F.lit(1)))


def replaced(t: Frames, incoming: DataFrame) -> tuple[DataFrame, None]:
    """Changes of ``merge.replace_pairs``: the scales of each incoming pair go, the incoming ones come."""
    pair = MAP[:2]
    old = t["outcome_maps"].join(incoming.select(*pair).distinct(), pair, "left_semi").select(*MAP)
    return signed_difference(old, incoming.select(*MAP).distinct()), None


def detached(t: Frames, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes of ``merge.detach``: courses leave programs, ``gone`` being (course_id, program_id), and their maps go."""
    gone = gone.select(*MEMBER).distinct()
    maps = _placed(t, t["outcome_maps"]).join(gone, MEMBER, "left_semi").select(*MAP)
    members = t["course_programs"].join(gone, MEMBER, "left_semi").select(*MEMBER)
    return maps.withColumn("sign", F.lit(-1)), members.withColumn("sign", F.lit(-1))


def reset(t: Frames, programs: DataFrame) -> tuple[DataFrame, None]:
    """Changes of ``merge.reset_scale_family``: all maps of the programs go."""
    plos = t["program_learning_outcomes"].join(programs.select("program_id").distinct(), "program_id", "left_semi")
    maps = t["outcome_maps"].join(plos.select("pl_outcome_id"), "pl_outcome_id", "left_semi").select(*MAP)
    return maps.withColumn("sign", F.lit(-1)), None


def _placed(t: Frames, maps: DataFrame) -> DataFrame:
    return maps.join(t["learning_outcomes"].select("l_outcome_id", "course_id"), "l_outcome_id").join(
        t["program_learning_outcomes"].select("pl_outcome_id", "program_id"), "pl_outcome_id")


class ProgramMapFeed:
    """The modal program map as parts below a folder that all executors share.

    ``links`` holds how often each scale is mapped per (program, outcome, course), whether or not the course is in the
    program, ``members`` which courses are, ``modes`` the modal cells of both. Because counts are kept and not modes alone,
    a mode falls back when its scale is withdrawn. A batch folds its signed changes into the parts they touch and writes
    those anew; ``heads`` names, for each part, the batch that wrote it last, and completes the batch. A batch that runs
    twice writes the same folders, so it counts once. Batches run in the order of their numbers, one at a time.

    A row withdrawn before it came leaves a count below zero, which its arrival cancels; only counts above zero show.
    Outcomes and scales are read when a batch is applied: if one of them is moved or renamed, feed its maps out and in.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _by_part(self, rows: DataFrame) -> DataFrame:
        # A number of tasks that adaptive execution leaves as it is: few would write the files of all parts in turn.
        return rows.repartition(self.buckets, "bucket")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        """Write rows that lie by part (``_by_part``)."""
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/batch={batch}")

    def _heads(self, batch: int) -> dict[str, dict[int, int]]:
        """By table and part, the batch up to ``batch`` that wrote it last: at most three times the number of parts."""
        found: dict[str, dict[int, int]] = {name: {} for name in _SCHEMAS}
        if batch >= 0:
            heads = self.spark.read.schema("name string, part int, written int").parquet(f"{self.folder}/heads/batch={batch}")
            for r in heads.collect():
                found[r["name"]][r["part"]] = r["written"]
        return found

    def _parts(self, name: str, heads: dict[int, int]) -> DataFrame:
        """The rows of the parts in ``heads``, each from the batch named there."""
        schema = f"{_SCHEMAS[name]}, bucket int"
        by_batch: dict[int, list[int]] = {}
        for part, written in heads.items():
            by_batch.setdefault(written, []).append(part)
        if not by_batch:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{name}/batch={n}" for n in sorted(by_batch)]
        rows = self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.folder}/{name}").parquet(*paths)
        # Conditions on the folders' columns alone, so other folders are not read.
        tests = [(F.col("batch") == n) & F.col("bucket").isin(parts) for n, parts in by_batch.items()]
        return rows.filter(reduce(lambda a, b: a | b, tests)).drop("batch")

    def _touched(self, name: str, batch: int, changes: DataFrame) -> DataFrame:
        """Write the summed changes by part and read them again."""
        part = F.pmod(F.xxhash64(*MEMBER), F.lit(self.buckets)).cast("int")
        summed = changes.groupBy(*_KEYS[name]).agg(F.sum("sign").alias("n")).filter("n <> 0").withColumn("bucket", part)
        path = f"{self.folder}/changes-{name}/batch={batch}"
        summed.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(f"{_SCHEMAS[name]}, bucket int").parquet(path)

    def apply(self, batch: int, t: Frames, maps: DataFrame | None, members: DataFrame | None) -> set[int]:
        """Take in signed changes of ``outcome_maps`` and ``course_programs`` as batch ``batch``; the parts written.

        Batch 0 takes the whole tables (see ``first_rows``). Either side may be None. ``t`` gives outcomes and scales.
        Maps of unknown outcomes or scales are left out, as in ``program_map``.
        """
        heads = self._heads(batch - 1)
        changes = {
            "links": None if maps is None else _placed(t, maps),
            "members": members,
        }
        touched: set[int] = set()
        for name, rows in changes.items():
            if rows is None:
                continue
            mine = self._touched(name, batch, rows)
            parts = {r[0] for r in mine.select("bucket").distinct().collect()}
            held = {p: n for p, n in heads[name].items() if p in parts}
            both = self._by_part(self._parts(name, held).unionByName(mine) if held else mine)
            if held:
                # Rows that lie by part are added up where they are; those of a first batch are sums already.
                both = both.groupBy(*_KEYS[name], "bucket").agg(F.sum("n").alias("n")).filter("n <> 0")
            self._write(both, name, batch)
            heads[name].update(dict.fromkeys(parts, batch))
            touched |= parts
        links, courses = (self._parts(name, {p: n for p, n in heads[name].items() if p in touched}).filter("n > 0")
                          for name in ("links", "members"))
        # The part follows from program and course, by which the cells are then grouped where they are joined.
        counts = links.drop("bucket").join(courses.drop("bucket").withColumnRenamed("n", "_times"), MEMBER)
        counts = counts.select(*CELL, "map_scale_id", (F.col("n") * F.col("_times")).alias("n"))
        part = F.pmod(F.xxhash64(*MEMBER), F.lit(self.buckets)).cast("int")
        self._write(self._by_part(modal(counts, t["mapping_scales"]).withColumn("bucket", part)), "modes", batch)
        heads["modes"].update(dict.fromkeys(touched, batch))
        rows = [(name, p, n) for name, parts in heads.items() for p, n in parts.items()]
        self.spark.createDataFrame(rows, "name string, part int, written int").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/heads/batch={batch}")
        return touched

    def cells(self, batch: int) -> DataFrame:
        """The modal cells after batch ``batch``, as ``maps.modal_cells`` gives them."""
        return self._parts("modes", self._heads(batch)["modes"]).drop("bucket")
