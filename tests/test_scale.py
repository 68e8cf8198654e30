"""Plans that must not grow with the tables in one place: no broadcast of copies, small partitions, no pairs before distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwise.operators.requests import request_pairs
from mapwise.plans import session
from mapwise.plans.session import tune
from mapwise.plans.skew import fan_out_join
from mapwise.sources import adapter


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_fan_out_join_are_not_broadcast(spark):
    many = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    few = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = fan_out_join(many, few, ["k"])
    assert "Broadcast" not in plan(joined)
    assert joined.count() == 1000


def test_pairs_copy_requests_and_broadcast_nothing(spark):
    requests = spark.createDataFrame([(1, 7, 0), (2, 7, 1)], "request_id long, course_id long, program_id long")
    clos = spark.createDataFrame([(10, 7, "a"), (11, 7, "b")], "l_outcome_id long, course_id long, l_outcome string")
    plos = spark.createDataFrame([(20, 0, "p"), (21, 1, "q")], "pl_outcome_id long, program_id long, pl_outcome string")
    pairs = request_pairs(requests, clos, plos)
    assert "Broadcast" not in plan(pairs)
    assert sorted((r.request_id, r.l_outcome_id, r.pl_outcome_id) for r in pairs.collect()) == [
        (1, 10, 20), (1, 11, 20), (2, 10, 21), (2, 11, 21)]


def test_prompts_are_stored_compressed(spark, tmp_path):
    """Each line holds the template and the levels: as plain text the files of all pairs would be far larger than the tables."""
    from mapwise.operators.requests import build_prompts
    from mapwise.sources.jsonl import write_prompts

    requests = spark.createDataFrame([(1, 7, 0)], "request_id long, course_id long, program_id long")
    clos = spark.range(50).select(F.lit(7).cast("long").alias("course_id"), F.col("id").alias("l_outcome_id"), F.lit("clo").alias("l_outcome"))
    plos = spark.range(20).select(F.lit(0).cast("long").alias("program_id"), F.col("id").alias("pl_outcome_id"), F.lit("plo").alias("pl_outcome"))
    scales = spark.createDataFrame([(0, 1, "Introduced", "I")], "program_id long, map_scale_id long, title string, abbreviation string")
    conf, key = spark.conf, "spark.sql.autoBroadcastJoinThreshold"
    before = conf.get(key)
    conf.set(key, "-1")
    try:
        prompts = build_prompts(requests, clos, plos, scales)[0]
        exchanges = [step for step in plan(prompts).splitlines() if "Exchange" in step]
    finally:
        conf.set(key, before)
    # The last exchange before the prompts deals out what is joined to pairs; pairs are not dealt out again for their levels.
    assert "_salt" in exchanges[0]
    write_prompts(prompts, str(tmp_path / "prompts"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "prompts")).collect()]
    stored = sum(p.stat().st_size for p in (tmp_path / "prompts").glob("part-*"))
    assert len(lines) == 1000 and all("I - Introduced" in x for x in lines) and stored < sum(map(len, lines)) / 5


def test_tables_are_broadcast_by_rows_not_by_files(spark, tmp_path):
    """A file of 2 MB with a million rows: small on disk, large as the hash table of a broadcast."""
    tune(spark)
    folder = str(tmp_path / "short")
    spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), F.lit("short text").alias("v")).coalesce(1).write.parquet(folder)
    rows = spark.range(10).withColumnRenamed("id", "k")
    short = spark.read.parquet(folder)
    assert "BroadcastHashJoin" not in plan(short.join(short.withColumnRenamed("v", "w"), "k"))
    assert "BroadcastHashJoin" in plan(short.join(rows, "k"))


def test_merged_partitions_stay_small(spark):
    """Half a million rows that compress to little are still aggregated in several tasks of a bounded size."""
    tune(spark)
    conf = spark.conf
    assert conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    assert int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 200
    assert conf.get("spark.sql.files.maxPartitionBytes") == "8m"


def test_exchanges_start_from_more_partitions_for_larger_tables(spark, tmp_path, monkeypatch):
    """Partitions are merged but never cut, so their number has to follow the tables' bytes."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for name, rows in (("orders", 1000), ("lineitem", 100_000)):
        spark.range(rows).select(F.xxhash64("id").alias("l_orderkey")).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(session, "BYTES_TO_START", 2000)
    tables = adapter.Tables(spark, str(tmp_path))
    assert spark.conf.get(key) == "200"
    stored = sum(p.stat().st_size for n in ("orders", "lineitem") for p in (tmp_path / f"{n}.parquet").glob("*.parquet"))
    assert tables["orders"].count() + tables["lineitem"].count() == 101_000
    assert int(spark.conf.get(key)) == -(-stored // 2000) > 200
    tune(spark)
    assert spark.conf.get(key) == "200"


def small_access(spark):
    """Users 1 (administrator), 2 (head with the faculty's courses, twice) and 3 (director of program 0 and its faculty)."""
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    org = "campus string, faculty string, department string"
    return {
        "campuses": table([(0, "O")], "campus_id long, campus string"),
        "faculties": table([(0, "F", 0)], "faculty_id long, faculty string, campus_id long"),
        "departments": table([(5, 0, "D")], "department_id long, faculty_id long, department string"),
        "faculty_course_codes": table([("MATH", 0)], "course_code string, faculty_id long"),
        "programs": table([(0, "O", "F", "D")], f"program_id long, {org}"),
        "courses": table([(i, "MATH", "O", "F", "D") for i in (10, 11, 12)], f"course_id long, course_code string, {org}"),
        "course_programs": table([(10, 0), (10, 0), (11, 0)], "course_id long, program_id long"),
        "roles": table([(1, "administrator")], "role_id long, role string"),
        "role_user": table([(1, 1)], "user_id long, role_id long"),
        "department_head": table([(2, 5, True), (2, 5, True), (2, 5, False)],
                                 "user_id long, department_id long, has_access_to_all_courses_in_faculty boolean"),
        "program_directors": table([(3, 0, True)], "user_id long, program_id long, has_access_to_all_courses_in_faculty boolean"),
        "course_users": table([(10, 3, 2), (10, 4, 3), (10, 4, 2), (11, None, None)], "course_id long, user_id long, permission long"),
        "program_users": table([(0, 4, 3)], "program_id long, user_id long, permission long"),
    }


def test_newest_of_scopes_keep_what_a_user_may_need(spark):
    """Only the newest of a scope meet its users; the newest ones of a user stay the same."""
    from mapwise.operators.access import entity_scopes, newest_of_scopes, visible_entities

    t = small_access(spark)
    dates = spark.createDataFrame([("course", 10, 1), ("course", 11, 3), ("course", 12, 2), ("program", 0, 1)],
                                  "entity string, entity_id long, updated_at long")
    kept = newest_of_scopes(entity_scopes(t), dates, 1).filter("entity = 'course'")
    assert {r.entity_id for r in kept.collect()} == {11}
    whole = {(r.user_id, r.entity, r.entity_id) for r in visible_entities(t).collect()}
    few = {(r.user_id, r.entity, r.entity_id) for r in visible_entities(t, dates, 1).collect()}
    assert few < whole and {(1, "course", 11), (2, "course", 11), (3, "course", 11), (None, "course", 11)} <= few
    assert (2, "course", 12) in whole and (2, "course", 12) not in few


def test_grants_of_overlapping_scopes_come_once(spark):
    from mapwise.operators.access import effective_permission, expand_grants

    t = small_access(spark)
    grants = [tuple(r) for r in expand_grants(t).collect()]
    assert len(grants) == len(set(grants))
    head = {(g[0], g[1], g[4]) for g in grants if g[2] == 2}
    assert head == {("program", 0, None), ("course", 10, 0), ("course", 11, 0),
                    ("course", 10, None), ("course", 11, None), ("course", 12, None)}
    assert {(g[0], g[1], g[4]) for g in grants if g[2] == 3} == {
        ("program", 0, 0), ("course", 10, 0), ("course", 11, 0), ("course", 12, 0)}
    level = {(r.entity, r.entity_id, r.user_id): r.permission for r in effective_permission(t).collect()}
    assert level[("course", 10, 3)] == 1 and level[("course", 10, 4)] == 2
    assert level[("course", 11, None)] == 0 and level[("program", 0, 3)] == 1


def test_visible_entities_come_by_user(spark):
    """The entities of a user lie together, so that files of very many pairs stay small; rows by entity repeat all users."""
    from itertools import groupby

    from mapwise.operators.access import expand_grants, visible_entities

    t = small_access(spark)
    t["courses"] = spark.range(10, 210).select(
        F.col("id").alias("course_id"), F.lit("MATH").alias("course_code"), *[F.lit(v).alias(k) for k, v in zip(
            ("campus", "faculty", "department"), "OFD", strict=True)])
    t["department_head"] = spark.range(100, 140).select(
        F.col("id").alias("user_id"), F.lit(5).cast("long").alias("department_id"), F.lit(True).alias("has_access_to_all_courses_in_faculty"))
    for found in (visible_entities(t), expand_grants(t, listed=True)):
        rows = found.filter("user_id >= 100").select(F.spark_partition_id().alias("part"), "user_id").collect()
        assert len(rows) > 40 * 200
        assert len(list(groupby(rows))) < len(rows) / 4
    assert sorted(map(str, expand_grants(t, listed=True).collect())) == sorted(map(str, expand_grants(t).collect()))


def test_grants_of_forty_thousand_rules_lie_by_entity(spark):
    """As many rules as a large copy of the tables has: what judges their grants by entity needs no exchange of pairs."""
    from mapwise.operators.access import granted, slices_of

    rules = spark.range(40_000).select(
        F.col("id").alias("user_id"), F.lit("r").alias("role"), F.when(F.col("id") % 2 == 0, "all").otherwise("faculty").alias("scope_kind"),
        (F.col("id") % 3).alias("scope_id"), F.lit(None).cast("long").alias("rule_program_id"), F.lit(None).cast("long").alias("department_id"))
    entities = spark.createDataFrame([("course", 1, "all", 0, None), ("program", 2, "faculty", 1, None)],
                                     "entity string, entity_id long, scope_kind string, scope_id long, via_program_id long")
    grants = granted(entities, rules, slices_of(rules))
    steps = plan(grants.groupBy("entity", "entity_id").count())
    assert "BroadcastHashJoin" in steps and "Exchange hashpartitioning(user_id" not in steps and steps.count("Exchange hashpartitioning") == 1


def test_partitions_of_documents_follow_their_bytes(spark):
    """Ten times the corpus gives ten times the partitions, none of them larger, whatever the session's number is."""
    from mapwise.sources.corpus import PARTITION_BYTES, corpus_lines, partitions_of

    def documents(n):
        text = F.when(F.col("id") % 5 > 0, F.expr("repeat('word of a line\n', 14000)"))
        return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), text.alias("text"))

    cores = spark.sparkContext.defaultParallelism
    assert partitions_of(documents(0)) == 1
    assert partitions_of(documents(5)) == min(cores, 1)
    few, many = 10 * cores * PARTITION_BYTES >> 20, 100 * cores * PARTITION_BYTES >> 20
    assert 9 < partitions_of(documents(many)) / partitions_of(documents(few)) < 11
    some = documents(15 * cores * PARTITION_BYTES >> 20)
    assert corpus_lines(some).select(F.spark_partition_id()).rdd.getNumPartitions() == partitions_of(some) > cores


def test_records_are_built_from_kept_extractors(spark):
    """No stage holds the steps of all extractors: over 100 of them, tasks may compile them anew."""
    from mapwise.operators.corpus.records import course_children, course_records
    from mapwise.sources.corpus import corpus_lines

    texts = spark.createDataFrame([(1, "s", "one two three"), (2, "s", "four")], "doc_id long, source string, text string")
    lines = corpus_lines(texts)
    for found in (course_records(lines, 1, 2026), course_children(lines)):
        steps = plan(found)
        assert steps.count("Generate") + steps.count("Window") + steps.count("Sort") < 30
        assert found.select("doc_id").distinct().count() == 2


def test_parts_of_a_feed_are_exchanged_once(spark, tmp_path):
    """Rows that lie by part are added up where they are: one exchange by part, none by key before it."""
    from mapwise.operators.map_feed import ProgramMapFeed

    class Seen(ProgramMapFeed):
        plans: list = []

        def _write(self, rows, name, batch):
            self.plans.append((name, batch, rows._jdf.queryExecution().executedPlan().toString()))
            super()._write(rows, name, batch)

    maps = spark.createDataFrame([(1, 5, 1, 1), (1, 5, 1, 1), (2, 6, 2, 1)], "l_outcome_id long, pl_outcome_id long, map_scale_id long, sign int")
    members = spark.createDataFrame([(0, 7, 1), (1, 7, 1)], "program_id long, course_id long, sign int")
    t = {
        "learning_outcomes": spark.createDataFrame([(1, 7), (2, 7)], "l_outcome_id long, course_id long"),
        "program_learning_outcomes": spark.createDataFrame([(5, 0), (6, 1)], "pl_outcome_id long, program_id long"),
        "mapping_scales": spark.createDataFrame([(1, "I", "#1"), (2, "D", "#2")], "map_scale_id long, abbreviation string, colour string"),
    }
    feed = Seen(spark, str(tmp_path / "feed"), 4)
    feed.apply(0, t, maps, members)
    feed.apply(1, t, maps.withColumn("sign", -F.col("sign")).limit(1), None)
    assert {(name, batch) for name, batch, _ in Seen.plans} >= {("links", 0), ("links", 1), ("modes", 1)}
    for name, _, steps in Seen.plans:
        if name != "modes":
            assert steps.count("Exchange") == 1 and "REPARTITION_BY_NUM" in steps
    cells = {(r.program_id, r.pl_outcome_id): (r.label, r.n) for r in feed.cells(1).collect()}
    assert cells == {(0, 5): ("I", 1), (1, 6): ("D", 1)}
