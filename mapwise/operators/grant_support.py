"""Grants kept up by support counts: a change joins only what it touches, and a count of zero revokes."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mapwise.operators.access import (
    ENTITY, GRANT, GRANT_SCHEMA, MOST_SLICES, PROGRAM_DIRECTOR, RULE, RULES_PER_SLICE, SCOPED, assignment_rules, entity_scopes,
    granted,
)
from mapwise.operators.programs import Frames

#: Parts that scopes and users are stored by; the largest number of parts a change can name.
BUCKETS = 16


def scopes(t: Frames) -> tuple[DataFrame, DataFrame]:
    """All entities by scope and all rules of the tables; a program is also a scope of its own, which its directors open."""
    own, null = F.lit("own program").alias("scope_kind"), F.lit(None).cast("long")
    programs = t["programs"].select(
        F.lit("program").alias("entity"), F.col("program_id").alias("entity_id"), own, F.col("program_id").alias("scope_id"),
        null.alias("via_program_id"))
    directors = t["program_directors"].select(
        "user_id", F.lit(PROGRAM_DIRECTOR).alias("role"), own, F.col("program_id").alias("scope_id"),
        F.col("program_id").alias("rule_program_id"), null.alias("department_id"))
    return entity_scopes(t).unionByName(programs), assignment_rules(t).unionByName(directors)


def signed_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with the number of times they came (positive) or went (negative), as ``sign``; equal rows cancel out."""
    columns = before.columns
    both = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
    return both.groupBy(*columns).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")


def supported(entities: DataFrame, rules: DataFrame, slices: int) -> DataFrame:
    """Signed entities and rules that meet in a scope, a row for each pair: (GRANT, support), the product of their signs.

    Pairs of one grant are not added up here: whoever reads the log adds up its batches anyway.
    """
    signed = [side.drop("scope_bucket").withColumnRenamed("sign", name) for side, name in ((entities, "_e"), (rules, "_r"))]
    met = granted(*signed, slices, "_e", "_r")
    return met.select(*GRANT, (F.col("_e") * F.col("_r")).cast("long").alias("support")).filter("support <> 0")


class GrantSupport:
    """The grants of all users as signed logs below a folder that all executors share.

    ``entities`` holds which course or program lies in which scope, ``rules`` which assignment opens which scope, and
    ``support`` the pairs of the two that justify each grant; all as rows that came or went by batch. The first two are
    stored by kind and bucket of their scopes, the third by bucket of its users. A batch reads the rules of the scopes
    whose entities change and the entities of the scopes whose rules change, and writes three folders of its own; nothing
    that was written before is read as a whole or written again. A batch that runs twice writes the same folders, so it
    counts once. Batches run in the order of their numbers, one at a time.

    Within the bucket of its users ``support`` is bucketed by entity, into the slices that pairs meet in: the batches of a grant
    lie in the same bucket, so they are added up without an exchange. The number of slices is that of the first batch.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._table = "grant_support_" + hashlib.md5(self.folder.encode()).hexdigest()

    def _write(self, rows: DataFrame, name: str, batch: int, parts: list[str]) -> None:
        rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.folder}/{name}/batch={batch}")

    def _read(self, name: str, batches: range, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/batch={n}" for n in batches]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("batch")
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths).drop("batch")

    def _scoped(self, name: str, batches: range, parts: list[tuple[str, int]] | None = None) -> DataFrame:
        columns = SCOPED if name == "entities" else RULE
        rows = self._read(name, batches, f"{columns}, sign int, scope_kind string, scope_bucket int, batch int")
        if parts is not None:
            # Constant conditions on the folders' columns, so other folders are not listed for reading.
            tests = [(F.col("scope_kind") == kind) & (F.col("scope_bucket") == bucket) for kind, bucket in parts]
            rows = rows.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))
        return rows

    def _slices(self) -> int:
        return self.spark.read.schema("slices int").parquet(f"{self.folder}/slices").first()[0]

    def _declare(self) -> None:
        self.spark.sql(
            f"create table {self._table} ({GRANT_SCHEMA}, support long, batch int, user_bucket int) using parquet "
            f"partitioned by (batch, user_bucket) clustered by ({', '.join(ENTITY)}) into {self._slices()} buckets "
            f"location '{self.folder}/support'")

    def _log(self) -> DataFrame:
        """The rows of ``support``: a table over its folder, declared in each session that uses it."""
        if not self.spark.catalog.tableExists(self._table):
            self._declare()
            self.spark.catalog.recoverPartitions(self._table)
        return self.spark.table(self._table)

    def _write_support(self, rows: DataFrame, batch: int) -> list[int]:
        """Write the folder of a batch, and name the buckets of users in it. A task keeps a file open for each instead of sorting."""
        into, conf, key = self._log(), self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int").alias("user_bucket")
        rows = rows.select(*[c for c in into.columns if c not in ("batch", "user_bucket")], bucket)
        before = conf.get(key)
        conf.set(key, str(BUCKETS))
        try:
            self.spark.sql(f"insert overwrite table {self._table} partition (batch = {batch}, user_bucket) select * from {{rows}}", rows=rows)
        finally:
            conf.set(key, before)
        # Folders, of which there are at most BUCKETS.
        folders = self.spark.sql(f"show partitions {self._table} partition (batch = {batch})").collect()
        return sorted(int(f.partition.rsplit("=", 1)[1]) for f in folders)

    def _folded(self, upto: int, users: list[int], *sums: Column) -> DataFrame:
        """``sums`` of the grants of some buckets of users over the batches up to ``upto``, a bucket after the other.

        Rows lie by entity already: each task adds up one slice of a bucket's grants.
        """
        log = self._log().filter(F.col("batch") <= upto)
        parts = [log.filter(F.col("user_bucket") == b).groupBy(*GRANT).agg(*sums) for b in users]
        return reduce(DataFrame.unionByName, parts) if parts else log.filter(F.lit(False)).groupBy(*GRANT).agg(*sums)

    def apply(self, batch: int, entities: DataFrame | None, rules: DataFrame | None) -> DataFrame:
        """Take in signed changes (see ``signed_difference``) as batch ``batch``: (GRANT, before, after) of what changed.

        ``before`` and ``after`` are support counts: a grant is new where ``before`` is 0 and revoked where ``after`` is 0.
        Batch 0 takes the whole tables. Either side may be None. Null ids of users or entities are values like others.
        """
        changes = {"entities": entities, "rules": rules}
        earlier, touched, now = range(batch), {}, {}
        for name, rows in changes.items():
            scoped = f"{SCOPED if name == 'entities' else RULE}, sign int, scope_kind string"
            rows = self.spark.createDataFrame([], scoped) if rows is None else rows
            rows = rows.withColumn("scope_bucket", F.pmod(F.xxhash64("scope_id"), F.lit(BUCKETS)).cast("int"))
            self._write(rows, name, batch, ["scope_kind", "scope_bucket"])
            now[name] = self._scoped(name, range(batch, batch + 1))
            # At most the kinds of scopes times BUCKETS rows.
            touched[name] = [tuple(r) for r in now[name].select("scope_kind", "scope_bucket").distinct().collect()]
        pairs = [(now["entities"], now["rules"])]
        if batch:
            pairs += [(self._scoped("entities", earlier, touched["rules"]), now["rules"]),
                      (now["entities"], self._scoped("rules", earlier, touched["entities"]))]
        else:
            # A task writes a file for each bucket of users, so there are fewer slices than where pairs are compared.
            slices = max(BUCKETS, min(MOST_SLICES // 4, now["rules"].count() // RULES_PER_SLICE // 4))
            self.spark.sql(f"drop table if exists {self._table}")
            self.spark.createDataFrame([(slices,)], "slices int").write.mode("overwrite").parquet(f"{self.folder}/slices")
            self._declare()
        slices = self._slices()
        delta = reduce(DataFrame.unionByName, [supported(e, r, slices) for e, r in pairs])
        users = self._write_support(delta, batch)
        # Only the grants of the change meet their own counts: one key each, added up before they are compared.
        earlier_support = F.when(F.col("batch") < batch, F.col("support"))
        sums = self._folded(
            batch, users, F.coalesce(F.sum(earlier_support), F.lit(0)).alias("before"), F.sum("support").alias("after"),
            F.max(F.col("batch") == batch).alias("_new"))
        return sums.filter("_new and before <> after").drop("_new")

    def current(self, upto: int) -> DataFrame:
        """The grants after batch ``upto`` with the number of pairs that justify each: (GRANT, support)."""
        return self._folded(upto, list(range(BUCKETS)), F.sum("support").alias("support")).filter("support > 0")
