"""Hand-written cases for the rules the generated tables do not single out."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mapwise.functions import rules
from mapwise.operators import access, coverage, evaluation, grant_support, map_feed, maps, merge, requests
from mapwise.operators.corpus import assessments, fields, materials, pages, records, sections
from mapwise.plans.numbering import number_rows
from mapwise.plans.skew import fan_out_join
from mapwise.sources import imports, jsonl, sinks, tables
from mapwise.streaming import log, results


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


SCALES = [
    (0, "Not Applicable", "N/A", "#ffffff", 0), (1, "Introduced", "I", "#80bdff", 1), (2, "Developing", "D", "#1aa7ff", 1),
    (3, "Advanced", "A", "#0065bd", 1), (4, "Principal", "P", "#9be1e1", 2), (5, "Secondary", "S", "#75aeb7", 2),
    (6, "Major", "Ma", "#34789d", 2), (7, "Minor", "Mi", "#124778", 2), (11, "Exposure", "X", "#aabbcc", None),
    (12, "Zenith", "Z", None, None),
]


def small_program(spark, mapped):
    """One program (1), one course (1), one PLO (1); ``mapped`` lists (CLO, scale)."""
    clos = sorted({c for c, _ in mapped})
    return {
        "outcome_maps": spark.createDataFrame([(c, 1, s) for c, s in mapped], "l_outcome_id long, pl_outcome_id long, map_scale_id long"),
        "learning_outcomes": spark.createDataFrame([(c, 1, f"o{c}") for c in clos], "l_outcome_id long, course_id long, l_outcome string"),
        "program_learning_outcomes": spark.createDataFrame([(1, 1)], "pl_outcome_id long, program_id long"),
        "course_programs": spark.createDataFrame([(1, 1, 1)], "course_id long, program_id long, course_required long"),
        "courses": spark.createDataFrame([(1, "101")], "course_id long, course_num string"),
        "mapping_scales": spark.createDataFrame(SCALES, "map_scale_id long, title string, abbreviation string, colour string, mapping_scale_categories_id long"),
    }


def test_tie_is_joined_and_white(spark):
    t = small_program(spark, [(1, 1), (2, 1), (3, 2), (4, 2)])
    assert rows(maps.modal_cells(t), "label", "is_tie", "colour", "n") == [("I / D", True, "#ffffff", 2)]


def test_tie_flag_means_several_maxima(spark):
    t = small_program(spark, [(1, 1), (2, 1), (3, 2)])
    assert rows(maps.modal_cells(t), "label", "is_tie", "colour") == [("I", False, "#80bdff")]


@pytest.mark.parametrize("scales, label", [
    ([1, 1, 3], "A"), ([7, 4, 5], "P"), ([0, 0], "N/A"), ([11, 12], "Z"), ([0, 2], "D"),
])
def test_dominant_level(spark, scales, label):
    t = small_program(spark, [(i, s) for i, s in enumerate(scales)])
    assert rows(maps.dominant_cells(t), "label") == [(label,)]


def test_final_merges_only_beside_final_exam(spark):
    counts = spark.createDataFrame(
        [(1, "all", "Final", 2), (1, "all", "Final Exam", 3), (1, "year1", "Final", 1), (2, "all", "Final", 4)],
        "program_id long, scope string, a_method string, n long")
    assert rows(coverage.merge_finals(counts), "program_id", "scope", "a_method", "n") == [
        (1, "all", "Final Exam", 5), (1, "year1", "Final", 1), (2, "all", "Final", 4)]


def test_graduate_scope(spark):
    df = spark.createDataFrame([("512", 1), ("601", 0), ("499", 1), (None, 1)], "num string, req long")
    scopes = [set(r[0]) for r in df.select(rules.scope_array(F.col("num"), F.col("req"))).collect()]
    assert ["graduate" in s for s in scopes] == [True, True, False, False]


@pytest.mark.parametrize("seconds, phrase", [
    (0, "0 seconds ago"), (1, "1 second ago"), (59, "59 seconds ago"), (3600, "1 hour ago"),
    (86400 * 8, "1 week ago"), (86400 * 800, "2 years ago"),
])
def test_age_phrase(spark, seconds, phrase):
    assert spark.range(1).select(rules.age_phrase(F.lit(seconds))).first()[0] == phrase


def test_words_are_capitalised_not_lowered(spark):
    assert spark.range(1).select(rules.capitalise_words(F.lit("lab rEport iI"))).first()[0] == "Lab REport II"


@pytest.mark.parametrize("text, parts", [
    ("clo-10__plo-20", ("10", "20")), ("clo-a1__plo-b-2-c", ("a1", "b-2-c")), ("plo-1__clo-2", (None, None)),
    ("", (None, None)), (None, (None, None)),
])
def test_pair_id(spark, text, parts):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(rules.pair_part(F.col("t"), 1), rules.pair_part(F.col("t"), 2)).first()) == parts


ANSWERS = [
    r'{"generated_text": "<think>a</think> {\"id\": \"clo-1__plo-2\", \"CLO\": \"x\", \"is_mapped\": true, \"mapLabels\": [\"I\"]}"}',
    r'[{"generated_text": "{\"id\": \"clo-3__plo-4\"}"}]',
    r'{"generated_text": "ID: clo-5__plo-6\nCLO: text\nExplanation: a: b"}',
    r'{"generated_text": "one </think> two </think> {\"id\": \"clo-7__plo-8\"}"}',
    '{"generated_text": "no id"}', '{"other": 1}', "{broken", "   ", "[]", "\t ",
    r'{"generated_text": "{\"id\": \"clo-9__plo-9\", \"is_mapped\": true, \"mapLabels\": \"I\"}"}',
]


def test_answers(spark):
    good, rejects = requests.process_results(spark.createDataFrame([(a,) for a in ANSWERS], "line string"))
    assert rows(good, "clo_id", "plo_id", "clo", "is_mapped", "explanation", "map_labels") == [
        ("1", "2", "x", True, None, ["I"]), ("3", "4", "", False, None, []), ("5", "6", "text", False, "a: b", []),
        ("9", "9", "", True, None, ["I"])]
    assert sorted(r[0] for r in rejects.select("reason").collect()) == [
        "bad id", "bad id", "malformed line", "no text", "no text"]


def test_cut_and_lenient_answers(spark):
    texts = [
        (1, '<think>why</think>{"id": "a", "mapLabels": ["I"], "explanation": "cut o'),
        (2, "<think>w</think>[{id: 'b', mapLabels: ['R', 'E'],}, {'id': 'c', 'mapLabels': []}]"),
        (3, "no answer"),
    ]
    good, rejects = requests.explode_answers(spark.createDataFrame(texts, "n long, generated_text string"))
    assert rows(good, "n", "reasoning", "id", "map_labels") == [
        (1, "why", "a", ["I"]), (2, "w", "b", ["R", "E"]), (2, "w", "c", [])]
    assert rows(rejects, "n", "item_no") == [(3, None)]


def test_an_item_without_id_leaves_the_others(spark):
    text = "<think>w</think>[{'mapLabels': ['I']}, {'id': 'b', 'mapLabels': ['R']}, {'explanation': 'x'}]"
    good, rejects = requests.explode_answers(spark.createDataFrame([(1, text)], "n long, generated_text string"))
    assert rows(good, "id", "map_labels") == [("b", ["R"])]
    assert rows(rejects, "n", "item_no") == [(1, 0), (1, 2)]


def test_the_last_answer_counts(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 0)], "id long, score long")
    answers = spark.createDataFrame([("r", 1, 0, ["I"]), ("r", 1, 1, [])], "run_id string, id long, position long, map_labels array<string>")
    assert rows(evaluation.attach_predictions(pairs, answers), "id", "pred_score") == [(1, 0), (2, 0)]


def test_undated_requests_are_set_aside(spark):
    df = spark.createDataFrame([(1, 1, "PENDING", None), (2, 1, "PENDING", "2025-12-31 23:59:00"), (3, 1, "PENDING", "2025-12-31 23:00:00")],
                               "request_id long, program_id long, status string, created_at string")
    df = df.withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert rows(requests.pending_backlog(df, "2026-01-01 00:00:00"), "request_id", "position", "wait_seconds") == [(2, 2, 60), (3, 1, 3600)]
    assert rows(requests.pending_undated(df), "request_id") == [(1,)]


def test_numbering_keeps_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, 5), (1, None), (1, 70)], "k long, v long")
    got = number_rows(df, ["k"], [F.col("v")], F.floor(F.col("v") / 64), "n")
    assert rows(got, "*") == sorted([(None, None, 1), (None, 5, 2), (1, None, 1), (1, 70, 2)], key=str)


def test_routes_derive_empty_paths(spark):
    asked = spark.createDataFrame([(1, 1, 1, "AWAITING_COMPLETION", "s/batch_inputs/1", "")],
                                  "request_id long, course_id long, program_id long, status string, input_path string, output_path string")
    found = spark.createDataFrame([("s/batch_outputs/1.out",)], "output_path string")
    assert rows(requests.route_requests(asked, found), "output_path", "n_results") == [("s/batch_outputs/1.out", 1)]


def test_owner_election(spark):
    members = spark.createDataFrame([
        (1, 10, None), (2, 21, "2020-01-02"), (2, 20, "2020-01-05"), (3, 31, None), (3, 30, "2021-01-01"),
        (4, 41, None), (4, 40, None)], "course_id long, user_id long, created_at string")
    assert rows(access.elect_owner(members, "course_id"), "course_id", "user_id", "permission") == [
        (1, 10, 1), (2, 20, 2), (2, 21, 1), (3, 30, 1), (3, 31, 2), (4, 40, 1), (4, 41, 2)]


def grants_tables(spark, wide):
    f = spark.createDataFrame
    return {
        "role_user": f([(1, 1), (2, 2), (3, 3)], "user_id long, role_id long"),
        "roles": f([(1, "administrator"), (2, "department head"), (3, "program director")], "role_id long, role string"),
        "campuses": f([(1, "O")], "campus_id long, campus string"),
        "faculties": f([(1, "Arts", 1)], "faculty_id long, faculty string, campus_id long"),
        "departments": f([(1, 1, "Music"), (2, 1, "Law")], "department_id long, faculty_id long, department string"),
        "programs": f([(100, "O", "Arts", "Music"), (200, "O", "Arts", "Law")], "program_id long, campus string, faculty string, department string"),
        "courses": f([(1, "MUS", "O", "Arts", "Music"), (2, "LAW", "O", "Arts", "Law"), (3, "MUS", None, None, None),
                      (4, "XYZ", None, None, None)],
                     "course_id long, course_code string, campus string, faculty string, department string"),
        "course_programs": f([(4, 100), (2, 200)], "course_id long, program_id long"),
        "faculty_course_codes": f([("MUS", 1)], "course_code string, faculty_id long"),
        "department_head": f([(2, 1, wide)], "user_id long, department_id long, has_access_to_all_courses_in_faculty boolean"),
        "program_directors": f([(3, 200, wide)], "user_id long, program_id long, has_access_to_all_courses_in_faculty boolean"),
    }


@pytest.mark.parametrize("wide, head, director", [
    (False, {("course", 1), ("course", 4), ("program", 100)}, {("course", 2), ("program", 200)}),
    (True, {("course", 1), ("course", 2), ("course", 3), ("course", 4), ("program", 100)},
     {("course", 1), ("course", 2), ("course", 3), ("program", 200)}),
])
def test_grants(spark, wide, head, director):
    got = access.expand_grants(grants_tables(spark, wide)).collect()
    by_user = lambda u: {(r.entity, r.entity_id) for r in got if r.user_id == u}
    assert by_user(1) == {("course", i) for i in (1, 2, 3, 4)} | {("program", 100), ("program", 200)}
    assert by_user(2) == head
    assert by_user(3) == director


def test_stale_grants_are_the_unjustified_ones(spark):
    before = access.expand_grants(grants_tables(spark, True))
    now = grants_tables(spark, False)
    stale = access.stale_grants(now, before)
    assert {(r.user_id, r.entity_id) for r in stale.collect()} == {(2, 2), (2, 3), (3, 1), (3, 3)}
    kept = before.join(stale, access.GRANT[:4], "left_anti")
    assert access.stale_grants(now, kept).count() == 0


def test_stale_grants_are_judged_without_ids_and_twice(spark):
    t = grants_tables(spark, True)
    t["courses"] = t["courses"].union(spark.createDataFrame([(None, "MUS", "O", "Arts", "Music")], t["courses"].schema))
    held = access.expand_grants(t)
    assert held.filter("entity_id is null").count() > 0 and access.stale_grants(t, held).count() == 0
    other = held.filter("user_id = 2").withColumn("user_id", F.lit(None).cast("long"))
    assert access.stale_grants(t, other.unionByName(other)).count() == 2 * other.count()


def test_grants_meet_and_are_judged_without_an_exchange_of_pairs(spark):
    t = grants_tables(spark, True)
    held = access.expand_grants(t)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    # Beside the grants' own steps only scopes are exchanged, once for entities with an id and once for those without.
    assert exchanges(access.stale_grants(grants_tables(spark, False), held)) <= exchanges(held) + 4
    entities, rules = grant_support.scopes(t)
    pairs = grant_support.supported(entities.withColumn("sign", F.lit(1)), rules.withColumn("sign", F.lit(1)), 40)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "support" in plan and pairs.rdd.getNumPartitions() == 40


def test_grants_of_many_rules_meet_without_a_broadcast(spark, monkeypatch):
    t = grants_tables(spark, True)
    want = access.expand_grants(t).collect()
    monkeypatch.setattr(access, "MOST_SLICES", 1)
    held = access.expand_grants(t)
    assert sorted(map(str, held.collect())) == sorted(map(str, want))
    assert {(r.user_id, r.entity_id) for r in access.stale_grants(grants_tables(spark, False), held).collect()} == {
        (2, 2), (2, 3), (3, 1), (3, 3)}
    entities, rules = grant_support.scopes(t)
    pairs = grant_support.supported(entities.withColumn("sign", F.lit(1)), rules.withColumn("sign", F.lit(1)), 8)
    assert {tuple(r) for r in pairs.select(*access.GRANT).distinct().collect()} == {tuple(r) for r in want}


def test_grants_by_support_follow_any_series_of_changes(spark, tmp_path):
    draw = random.Random(8)
    store = grant_support.GrantSupport(spark, str(tmp_path / "support"))
    tables, before = grants_tables(spark, True), None
    for batch in range(4):
        now = grant_support.scopes(tables)
        if before is None:
            changes = [side.withColumn("sign", F.lit(1)) for side in now]
        else:
            changes = [grant_support.signed_difference(a, b) for a, b in zip(before, now, strict=True)]
        for _ in range(1 + batch % 2):  # a batch that runs again counts once
            changed = store.apply(batch, *changes)
        want = {tuple(r) for r in access.expand_grants(tables).collect()}
        held = {tuple(r)[:6]: r.support for r in store.current(batch).collect()}
        assert set(held) == want and min(held.values()) > 0
        news = {tuple(r)[:6] for r in changed.filter("before = 0").collect()}
        gone = {tuple(r)[:6] for r in changed.filter("after = 0").collect()}
        assert batch == 0 or (news == want - last and gone == last - want)
        last, before = want, now
        pick = lambda df: df.filter(F.col(df.columns[0]).isin(draw.sample(range(1, 5), 3)))
        tables = {**grants_tables(spark, batch % 2 == 0), "course_programs": pick(grants_tables(spark, True)["course_programs"]),
                  "department_head": pick(grants_tables(spark, batch % 2 == 0)["department_head"])}


def test_support_is_added_up_where_it_lies(spark, tmp_path):
    """The log of each bucket of users lies by entity: no grant is exchanged to add up its batches, also in a later session."""
    store = grant_support.GrantSupport(spark, str(tmp_path / "support"))
    t = grants_tables(spark, True)
    sides = grant_support.scopes(t)
    store.apply(0, *(side.withColumn("sign", F.lit(1)) for side in sides))
    changed = store.apply(1, None, sides[1].filter("user_id = 2").withColumn("sign", F.lit(-1)))
    for folded in (store.current(1), changed):
        steps = folded._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in steps and "Exchange" not in steps
    want = {tuple(r) for r in access.expand_grants(t).collect()}
    spark.sql(f"drop table {store._table}")  # as in a session that has not seen the log yet
    again = grant_support.GrantSupport(spark, str(tmp_path / "support"))
    assert {tuple(r)[:6] for r in again.current(0).collect()} == want
    assert {tuple(r)[:6] for r in again.current(1).collect()} == {g for g in want if g[2] != 2}
    assert {tuple(r)[:6] for r in changed.collect()} == {g for g in want if g[2] == 2}


def test_program_map_follows_its_change_feed(spark, tmp_path):
    draw = random.Random(5)
    scales = [(0, "N/A", None), (1, "I", "#111111"), (2, "D", "#222222"), (3, "A", "#333333")]
    t = {
        "mapping_scales": spark.createDataFrame(scales, "map_scale_id long, abbreviation string, colour string"),
        "learning_outcomes": spark.createDataFrame([(10 * c + k, c) for c in range(1, 5) for k in range(3)], "l_outcome_id long, course_id long"),
        "program_learning_outcomes": spark.createDataFrame([(100 * p + k, p) for p in (1, 2) for k in range(2)], "pl_outcome_id long, program_id long"),
        "course_programs": spark.createDataFrame(
            [(c, p, 1, 2) for c in range(1, 5) for p in (1, 2) if c + p != 6], "course_id long, program_id long, course_required long, map_status long"),
        "outcome_maps": spark.createDataFrame(
            [(10 * c + k, 100 * p + j, s) for c in range(1, 5) for k in range(3) for p in (1, 2) for j in range(2)
             for s in draw.sample(range(4), 2)] + [(None, 100, 1), (999, 100, 1), (10, 100, 77)], "l_outcome_id long, pl_outcome_id long, map_scale_id long"),
        "mapping_scale_programs": spark.createDataFrame([], "map_scale_id long, program_id long"),
    }
    feed = map_feed.ProgramMapFeed(spark, str(tmp_path / "feed"), buckets=8)
    cells = ["program_id", "pl_outcome_id", "course_id", "label", "is_tie", "colour", "n"]

    def step(batch, changes):
        for _ in range(1 + batch % 2):  # a batch that runs again counts once
            touched = feed.apply(batch, t, *changes)
        return touched

    def agrees(batch):
        assert rows(feed.cells(batch), *cells) == rows(maps.modal_cells(t), *cells)

    step(0, map_feed.first_rows(t))
    agrees(0)
    for batch in (1, 2):
        incoming = spark.createDataFrame(
            [(10 * c, 100 * p, draw.randrange(4)) for c in draw.sample(range(1, 5), 2) for p in (1, 2)] * 2,
            "l_outcome_id long, pl_outcome_id long, map_scale_id long")
        touched = step(batch, map_feed.replaced(t, incoming))
        t["outcome_maps"] = merge.replace_pairs(t["outcome_maps"], incoming)
        agrees(batch)
        written = {int(p.name.split("=")[1]) for p in (tmp_path / f"feed/modes/batch={batch}").glob("bucket=*")}
        assert written <= touched and len(touched) < 8
    gone = spark.createDataFrame([(2, 1), (2, 2), (9, 9)], "course_id long, program_id long")
    step(3, map_feed.detached(t, gone))
    t.update(merge.detach(t, gone))
    agrees(3)
    before = t["outcome_maps"]
    step(4, map_feed.reset(t, spark.createDataFrame([(1,)], "program_id long")))
    t["outcome_maps"] = before.filter("pl_outcome_id is null or pl_outcome_id >= 200")
    agrees(4)
    back = map_feed.signed_difference(t["outcome_maps"], before)  # what was reset comes again, a course returns with it
    more = spark.createDataFrame([(1, 2, 1)], "program_id long, course_id long, sign int")
    step(5, (back, more))
    t["outcome_maps"] = before
    t["course_programs"] = t["course_programs"].union(spark.createDataFrame([(2, 1, 1, 2)], t["course_programs"].schema))
    agrees(5)
    step(6, (None, None))
    agrees(6)


def test_backlog_over_time_against_every_second(spark):
    draw = random.Random(9)
    begin = datetime(2025, 3, 1, 22, 50)
    events = [
        (i, draw.choice([1, 2, None]), draw.choice([7, 7, 7, 8, None]), draw.choice(["PENDING", "PENDING", "IN_PROGRESS", "AWAITING_COMPLETION"]),
         None if i % 13 == 0 else begin + timedelta(seconds=draw.randrange(9000)))
        for i in range(120)]
    df = spark.createDataFrame(events, "request_id long, course_id long, program_id long, status string, created_at timestamp")
    end = begin + timedelta(seconds=8000)
    spans = []
    dated = sorted((e for e in events if e[4]), key=lambda e: (e[4], e[0]))
    for n, e in enumerate(dated):
        later = [x[4] for x in dated[n + 1:] if x[1:3] == e[1:3]]
        stop = min([end, *later[:1]])
        if e[3] == "PENDING" and stop > e[4]:
            spans.append((e[2], e[0], int((e[4] - begin).total_seconds()), int((stop - begin).total_seconds())))
    now = str(end)
    base = spark.sql("select unix_timestamp(timestamp '2025-03-01 22:50:00')").first()[0]
    got = {(r.program_id, r.request_id, r.begun - base, r.ended - base) for r in requests.waiting_spans(df, now).collect()}
    assert got == set(spans)
    want = {}
    for program in {s[0] for s in spans}:
        own = [s for s in spans if s[0] == program]
        length = [sum(s[2] <= at < s[3] for s in own) for at in range(min(s[2] for s in own), max(s[3] for s in own))]
        first = min(s[2] for s in own) + length.index(max(length))
        want[program] = (max(length), begin + timedelta(seconds=first), length.count(max(length)), sum(length), round(sum(length) / len(length), 6))
    assert {r[0]: tuple(r)[1:] for r in requests.backlog_over_time(df, now).collect()} == want
    assert requests.backlog_over_time(df.limit(0), now).count() == 0


def test_outcome_imports_stop_at_max_rows(spark, tmp_path):
    for name, n in (("long", 40), ("short", 5)):
        (tmp_path / name).mkdir()
        lines = ["outcome,phrase"] + [('"two\nlines",p' if k == 2 else ",p" if k == 3 else f"o{k},p") for k in range(1, n + 1)]
        (tmp_path / name / "a.csv").write_text("\n".join(lines) + "\n")
    owners = spark.createDataFrame([("long", 1), ("short", 2)], "file_key string, course_id long")
    capped = imports.import_outcomes(spark, f"{tmp_path}/*/*.csv", owners, max_rows=30)[0]
    want = [k for k in range(1, 30) if k != 3]  # 29 rows below the header, one of them blank
    got = {r.outcome for r in capped.filter("course_id = 1").collect()}
    assert got == {"two\nlines" if k == 2 else f"o{k}" for k in want}
    assert capped.filter("course_id = 2").count() == 4
    assert imports.import_outcomes(spark, f"{tmp_path}/*/*.csv", owners)[0].filter("course_id = 1").count() == 39


def test_replace_pairs_is_idempotent(spark):
    schema = "l_outcome_id long, pl_outcome_id long, map_scale_id long"
    base = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 3)], schema)
    incoming = spark.createDataFrame([(1, 1, 3), (1, 1, 3)], schema)
    once = merge.replace_pairs(base, incoming)
    assert rows(once, "*") == [(1, 1, 3), (2, 1, 3)]
    assert rows(merge.replace_pairs(once, incoming), "*") == rows(once, "*")


def test_label_match(spark):
    scored = spark.createDataFrame([
        ("r", 1, 0, None, None, None, [], 0), ("r", 2, 1, "I", None, None, [], 0),
        ("r", 3, 1, "I", None, None, ["i, R"], 1), ("r", 4, 1, "I", "R", None, ["R"], 1),
        ("r", 5, 1, "E", None, None, ["X", "I"], 1), ("r", 6, 0, None, None, None, ["E"], 1)],
        "run_id string, id long, score long, i_label string, r_label string, e_label string, map_labels array<string>, pred_score long")
    assert tuple(evaluation.label_match(scored).first()) == ("r", 2, 1, 3, 0.5, 0.5)
    assert tuple(evaluation.binary_metrics(scored).first()) == ("r", 6, 0.666667, 1, 1, 3, 1)
    # 18 cells; wrong: id 2 I, id 3 R, id 4 I, id 5 I and E, id 6 E
    assert evaluation.hamming(scored).first()[1] == pytest.approx(6 / 18, abs=1e-6)


def test_undersample_is_balanced_and_repeatable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("long").alias("score"))
    drawn = rows(evaluation.undersample(df, 7), "id", "score")
    assert sum(s for _, s in drawn) == 100 and len(drawn) == 200
    assert drawn == rows(evaluation.undersample(df.repartition(5), 7), "id", "score")
    assert drawn != rows(evaluation.undersample(df, 8), "id", "score")


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_numbering_is_consecutive_under_skew(spark, keys):
    """One key holds nearly all rows, spread over many buckets."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(3).alias("k"))
    got = number_rows(df, keys, [F.col("id")], F.floor(F.col("id") / 64), "n")
    want = {}
    for r in df.orderBy("id").collect():
        key = r.k if keys else 0
        want.setdefault(key, []).append(r.id)
    for r in got.collect():
        assert want[r.k if keys else 0][r.n - 1] == r.id


@pytest.mark.parametrize("how", ["inner", "left"])
def test_fan_out_join_equals_plain_join(spark, how):
    many = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9).alias("k"))
    few = spark.createDataFrame([(0, "a"), (0, "b"), (4, "c")], "k long, v string")
    assert rows(fan_out_join(many, few, ["k"], how), "id", "k", "v") == rows(many.join(few, ["k"], how), "id", "k", "v")


def test_import_skips_header_and_blank(spark, tmp_path):
    (tmp_path / "clos.csv").write_text('Learning Outcome,Short Phrase\nKnow x,X\n,Y\n"Apply, y",\n')
    owners = spark.createDataFrame([("clos.csv", 7)], "file_key string, course_id long")
    (tmp_path / "other.csv").write_text('Learning Outcome,Short Phrase\n"Know x,\nand ""y""",Z\n')
    got, rejects = imports.import_outcomes(spark, str(tmp_path), owners, file_key=r"([^/]+)$")
    assert rows(got, "course_id", "outcome", "short_phrase") == [(7, "Apply, y", None), (7, "Know x", "X")]
    assert rows(rejects, "file_key", "outcome", "short_phrase") == [("other.csv", 'Know x,\nand "y"', "Z")]


def test_wide_sheet(spark):
    report = spark.createDataFrame([("c1", "p1", "I"), ("c1", "p2", ""), ("c2", "p1", "D")], "course string, plo string, value string")
    wide = sinks.wide_sheet(report, "course", "plo", "value", ["p1", "p2"])
    assert rows(wide, "course", "p1", "p2") == [("c1", "I", ""), ("c2", "D", None)]


def lines_of(spark, text, file_name="outline.pdf"):
    data = [(1, file_name, 0, i, 0.5, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(data, "doc_id long, file_name string, page_no long, line_no long, rel_top double, text string")


@pytest.mark.parametrize("text, name, want", [
    ("MATH 101 intro\nPHYS 200\nPHYS 200 again", "x.pdf", ("PHYS", 200)),
    ("MATH 101 or PHYS 200", "x.pdf", ("MATH", 101)),
    ("MATH 101", "biol_V 330.pdf", ("BIOL", 330)),
    ("see MATH 101A", "x.pdf", ("MATH", 101)),
    ("nothing here", "x.pdf", ("TEST", 999)),
])
def test_course_code(spark, text, name, want):
    assert rows(fields.course_code(lines_of(spark, text, name)), "code", "number") == [want]


CPS = [(1, "CPS", 101)]


@pytest.mark.parametrize("text, want", [
    ("12\nWidgets and You: CPS 101", "Widgets and You"), ("welcome\nCPS 101   – Widgets", "Widgets"),
    ("welcome\nCourse Title: Deep Widgets", "Deep Widgets"), ("7\nwelcome", "welcome"),
])
def test_course_title(spark, text, want):
    codes = spark.createDataFrame(CPS, "doc_id long, code string, number long")
    assert fields.course_title(lines_of(spark, text), codes).first()["title"].strip() == want


def test_title_at_the_top_of_the_first_page(spark):
    data = [(1, "f", 0, 0, 0.05, "Intro to Widgets")] + [(1, "f", p, p + 1, 0.5, f"CPS 101 body {p}") for p in range(3)]
    lines = spark.createDataFrame(data, "doc_id long, file_name string, page_no long, line_no long, rel_top double, text string")
    codes = spark.createDataFrame(CPS, "doc_id long, code string, number long")
    assert rows(fields.course_title(lines, codes), "title") == [("Intro to Widgets",)]


def test_word_documents_have_no_topics(spark):
    text = "Topics\n• First steps\n\nRequired Readings\n• Smith, J. (2019). Field Notes. Wiley."
    assert records.course_children(lines_of(spark, text)).filter("kind = 'topic'").count() == 1
    assert records.course_children(lines_of(spark, text, "a.DOCX")).count() == 0


@pytest.mark.parametrize("text, name, want", [
    ("Offered Fall 2024", "x.pdf", ("W1", 2024)),
    ("anything", "notes_2023 W2.pdf", ("W2", 2023)),
    ("Jan 5 2024, March 2024", "x.pdf", ("W2", 2023)),
    ("Jan 5 2024, March 2024 and 2025", "x.pdf", ("W2", 2024)),
    ("July 2024", "x.pdf", ("S2", 2024)),
    ("none", "x.pdf", ("W2", 1999)),
])
def test_course_term(spark, text, name, want):
    assert rows(fields.course_term(lines_of(spark, text, name), 1, 1999), "term", "year") == [want]


def test_sections(spark):
    text = ("Course Description\nA long look at methods.\nWith labs each week.\nLearning Outcomes\n1. Explain things\nwell\n2. Apply them\n"
            "\nTopics\n• First steps\n• Final exam\n• Second steps\nCOURSE POLICIES\nnone")
    lines = lines_of(spark, text)
    assert rows(sections.section_text(lines), "description") == [("A long look at methods. \nWith labs each week.",)]
    assert rows(sections.goal_items(lines), "position", "goal") == [(1, "Explain things well"), (2, "Apply them")]
    assert rows(sections.clean_topics(sections.topic_items(lines)), "position", "topic") == [(1, "First steps"), (2, "Second steps")]


def test_assessments(spark):
    text = "Midterm: 30%\nFinal Exam (70%)\nLate work loses 10%\nA 90%"
    assert rows(assessments.assessment_items(lines_of(spark, text)), "name", "weight") == [("Final Exam", 70.0), ("Midterm", 30.0)]
    text = "Components\nessay\nquiz set\nPercentage\n40%\n60%"
    assert rows(assessments.assessment_items(lines_of(spark, text)), "name", "weight") == [("essay", 40.0), ("quiz set", 60.0)]


def paged(spark, *texts):
    """Lines of one document with the given pages."""
    lines = [(p, line) for p, text in enumerate(texts) for line in text.split("\n")]
    data = [(1, "outline.pdf", p, i, 0.5, line) for i, (p, line) in enumerate(lines)]
    return spark.createDataFrame(data, "doc_id long, file_name string, page_no long, line_no long, rel_top double, text string")


SCHEDULE = """Course Schedule
Week    Topic                     Readings
1       History of rocks          Chapter 1
2       Methods of soil           Chapter 2
        used in the field         Notes
3       Final exam                None
4       1. Models of growth       Chapter 3
        2. Maps of water"""


def test_columns_are_the_gaps_that_all_lines_share(spark):
    cells = pages.table_cells(paged(spark, SCHEDULE + "\nplain text\nA line  with a gap\n\nno table"))
    table = rows(cells.filter("table_no = 1 and row_no in (1, 3, 5)"), "row_no", "col_no", "cell")
    assert table == [
        (1, 1, "Week"), (1, 2, "Topic"), (1, 3, "Readings"), (3, 1, "2"), (3, 2, "Methods of soil\nused in the field"),
        (3, 3, "Chapter 2\nNotes"), (5, 1, "4"), (5, 2, "1. Models of growth\n2. Maps of water"), (5, 3, "Chapter 3")]
    assert rows(cells.filter("table_no = 2"), "row_no", "col_no", "cell") == [(1, 1, "A line"), (1, 2, "with a gap")]
    # One line without the common gap takes it from the whole run.
    assert pages.table_cells(paged(spark, "a  b\nlong  b\nwider line  b")).select("col_no").distinct().count() == 2
    assert pages.table_cells(paged(spark, "ab  cd\n  ab  cd")).count() == 0
    assert pages.table_cells(paged(spark, "a\tb\nc\td")).count() == 4
    assert pages.table_cells(paged(spark, "x  " + "y" * 500)).count() == 0 and pages.table_cells(paged(spark, "")).count() == 0


def test_topics_come_from_tables_before_text(spark):
    lines = paged(spark, SCHEDULE, "5       Ice and snow              Chapter 4\n6       Rivers and lakes          Chapter 5\nGrading\n"
                  "Week    Topic\n9       Not a topic here")
    want = ["History of rocks", "Methods of soil used in the field", "Models of growth", "Maps of water", "Ice and snow",
            "Rivers and lakes", "Not a topic here"]
    got = [t for _, t in rows(pages.table_topics(lines), "line_no", "topic")]
    # The page on which the next section opens still belongs to the topics, as in the reference's rules; later ones do not.
    assert got == want
    lines = paged(spark, SCHEDULE, "Grading", "Week    Topic\n9       Not a topic here")
    assert [t for _, t in rows(sections.topic_items(lines), "line_no", "topic")] == want[:4]
    only_text = paged(spark, "Topics\n• First steps\n• Second steps")
    assert [t for _, t in rows(sections.topic_items(only_text), "line_no", "topic")] == ["First steps", "Second steps"]


def test_a_header_cut_off_by_the_page_end_names_the_columns(spark):
    # The first row of the page after is taken for the header's place.
    lines = paged(spark, "Topics\nWeek    Theme                Room", "1       Rivers of old        B1\n2       Lakes and ponds      B2\n3       Ice ages             B3")
    assert [t for _, t in rows(pages.table_topics(lines), "line_no", "topic")] == ["Lakes and ponds", "Ice ages"]


def test_a_topic_column_beside_its_header_is_rescued(spark):
    lines = paged(spark, "Topics\nWeek   Topics                      Room\n1               Water and rocks    B1\n2               Soil of old lands  B2\n3               Maps of the sea    B3")
    assert [t for _, t in rows(pages.table_topics(lines), "line_no", "topic")] == ["Water and rocks", "Soil of old lands", "Maps of the sea"]


def test_grading_tables_hold_no_topics(spark):
    text = SCHEDULE + "\n\nItem            Weight\nLong essay      60%\nShort essay     40%\n\n7       Ice and snow              Chapter 4\n8       Wind and rain             Chapter 5"
    assert [t for _, t in rows(pages.table_topics(paged(spark, text)), "line_no", "topic")][-1] == "Maps of water"
    assert pages.table_topics(paged(spark, "Topics\nItem            Weight\nLong essay      60%")).count() == 0


def test_modules_and_lists_in_cells_are_topics_of_their_own(spark):
    text = "Topics\nDate     Module Name\nMay 3    Module 1: Ice\n         Module 2: Snow cover\nMay 9    No labs (Urban trees 1)\n         Note: bring a pen\nMay 12   The wide open sea"
    assert [t for _, t in rows(pages.table_topics(paged(spark, text)), "line_no", "topic")] == [
        "Module 1: Ice", "Module 2: Snow cover", "Urban trees 1", "The wide open sea"]


def test_pages_of_class_times_and_contents_open_no_section(spark):
    table = "Week    Topic\n1       Water and rocks\n2       Soil and maps"
    assert pages.table_topics(paged(spark, "Schedule\nMonday 9:00\n\n" + table.replace("Topic", "Title"))).count() == 0
    assert pages.table_topics(paged(spark, "Schedule\nMonday 9:00\n\n" + table)).count() == 2
    assert pages.table_topics(paged(spark, "Table of contents\nTopics\n" + table)).count() == 0
    assert pages.table_topics(paged(spark, "Course structure\nLectures\n" + table)).count() == 2  # by the course structure
    assert pages.table_topics(paged(spark, table)).count() == 0


def test_titles_and_weights_come_from_tables_before_text(spark):
    text = ("Course Title: Some Words\nCode      Course Title      Credits\nBIO 100   Studies of Life   3\n\n"
            "Component        Due        Weight\nField report     March      25%\nGroup project              35%\n"
            "Written test     April      20%\n                 May        10.5\nAll              -          100%\nEssay: 60%\nTalk: 40%")
    lines = paged(spark, text)
    assert rows(pages.table_titles(lines), "title") == [("Studies of Life",)]
    codes = fields.course_code(lines)
    assert rows(fields.course_title(lines, codes), "title") == [("Studies of Life",)]
    # Blank cells close up, so the project has no weight below 'Weight'; the second line of the last row has no name.
    want = [("Field report", 25.0), ("Written test", 20.0)]
    assert rows(pages.table_weights(lines), "name", "weight") == want
    assert rows(assessments.assessment_items(lines), "name", "weight") == want
    # Text accepted on an earlier page comes before the table.
    lines = paged(spark, "Essay: 60%\nTalk: 40%", "Item           Mark\nField report   100 points\nTest           50%")
    assert rows(assessments.assessment_items(lines), "name", "weight") == [("Essay", 60.0), ("Talk", 40.0)]
    lines = paged(spark, "Essay: 20%", "Item           Mark\nField report   30\nTest           50%")
    assert rows(assessments.assessment_items(lines), "name", "weight") == [("Field report", 30.0), ("Test", 50.0)]


def test_technology_lines_are_skipped_and_suggested_readings_describe(spark):
    text = ("Required Readings\n• Smith, J. (2019). Field Notes. Wiley.\nTechnology requirements for this course: software\n"
            "Suggested reading materials for the term:\n• Hikes of the north")
    got = materials.material_items(lines_of(spark, text))
    assert rows(got, "name", "description") == [
        ("Hikes of the north", "suggested reading materials"), ("Smith, J. (2019). Field Notes. Wiley.", "Required Readings")]


def test_materials(spark):
    text = ("Required Readings\n• Smith, J. (2019). Field Notes. Wiley.\nvolume two\n\nData textbook: short\n\ndata textbook: longer text\n"
            "ACADEMIC INTEGRITY\nbook")
    got = materials.clean_materials(materials.material_items(lines_of(spark, text)))
    assert rows(got, "position", "name", "type", "description") == [
        (1, "Smith, J. (2019). Field Notes. Wiley. volume two", "textbook", "Required Readings"),
        (2, "data textbook", "textbook", "longer text")]


@pytest.mark.parametrize("stop", ["Lecture and Lab Schedule", "Academict Misconduct"])
def test_materials_end_at_every_stop(spark, stop):
    text = f"Required Readings\n• Smith, J. (2019). Field Notes. Wiley.\n{stop}\nsecond textbook: see week 2"
    got = materials.clean_materials(materials.material_items(lines_of(spark, text)))
    assert rows(got, "position", "name") == [(1, "Smith, J. (2019). Field Notes. Wiley.")]


@pytest.mark.parametrize("heading", ["Policies against Cheating", "Whom to Ask", "Don't Miss"])
def test_stop_words_do_not_hide_a_heading(spark, heading):
    lines = lines_of(spark, f"Course Description\nA long look at methods.\n{heading}\nnot part of it")
    assert rows(sections.section_text(lines), "description") == [("A long look at methods.",)]


def test_running_headers_are_dropped_everywhere(spark):
    data = [(1, "f", p, p * 3 + i, top, text) for p in range(3) for i, (top, text) in enumerate(
        [(0.02, f"Page {p} of 3"), (0.5, f"body {p}"), (0.95, "footer" if p else "other")])]
    lines = spark.createDataFrame(data, "doc_id long, file_name string, page_no long, line_no long, rel_top double, text string")
    assert [r[0] for r in fields.strip_headers(lines).orderBy("line_no").select("text").collect()] == ["body 0", "other", "body 1", "body 2"]


def test_long_lines_do_not_overflow(spark):
    line = "Required Readings\n" + "Smith, " * 20000 + "2019. end\n" + "A B " * 20000
    assert materials.material_items(lines_of(spark, line)).count() >= 0
    assert sections.goal_items(lines_of(spark, "Learning Outcomes\n" + "Word " * 20000)).count() >= 0


def test_log_replays_and_snapshots(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "k long, at long, v string"
    args = (spark, path, schema, ["k"], ["at"])
    assert log.current(*args).count() == 0 and log.take_snapshot(*args) is None
    sink = log.append(path)
    sink(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema), 0)
    sink(spark.createDataFrame([(1, 2, "c")], schema), 1)
    sink(spark.createDataFrame([(1, 2, "c")], schema), 1)
    assert rows(log.current(*args), "k", "v") == [(1, "c"), (2, "b")]
    assert log.take_snapshot(*args) == 1
    log.prune(spark, path)
    assert not (tmp_path / "log" / "batches" / "batch_id=0").exists()
    # An older row that comes late replaces nothing.
    sink(spark.createDataFrame([(2, 3, "d"), (1, 1, "late")], schema), 2)
    assert rows(log.current(*args), "k", "v") == [(1, "c"), (2, "d")]
    opened = log.current(*args).inputFiles()
    assert opened and not any("batch_id=0" in f or "batch_id=1" in f for f in opened)


@pytest.mark.parametrize("age, want", [(-5, "D"), (3600, "I"), (30 * 86400, "I")])
def test_newer_answer_replaces_older(spark, tmp_path, age, want):
    """The second file is listed later; it counts only if it is newer, and is read however old it is."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    line = '{"generated_text": "{\\"id\\": \\"clo-1__plo-%d\\", \\"mapLabels\\": [\\"%s\\"]}"}\n'
    now = int(time.time()) - 100
    for i, label in enumerate(["I", "D"]):
        file = source / f"part-{i}.txt"
        file.write_text(line % (2, label) + line % (3 + i, label) + "broken\n")
        os.utime(file, (now - age * i, now - age * i))
        results.stream_results(spark, str(source), target).awaitTermination()
    assert rows(results.suggestions(spark, target), "clo_id", "plo_id", "map_labels") == [
        ("1", "2", [want]), ("1", "3", ["I"]), ("1", "4", ["D"])]


def test_jsonl_round_trip_keeps_text(spark, tmp_path):
    prompts = spark.createDataFrame([(1, 2, "clo-1__plo-2", "né „quoted“\nline")], "course_id long, program_id long, pair_id string, prompt string")
    path = str(tmp_path / "prompts")
    jsonl.write_prompts(prompts, path)
    line = spark.read.text(path).select("value").first()[0]
    assert "né „quoted“" in line and '"max_new_tokens":1500' in line


def test_tables_round_trip(spark, tmp_path):
    t = {"course_programs": spark.createDataFrame([(1, 2, 1, 0)], "course_id long, program_id long, course_required int, map_status int")}
    tables.write_tables(t, str(tmp_path))
    back = tables.load_tables(spark, str(tmp_path), ["course_programs"])["course_programs"]
    assert rows(back, "*") == [(1, 2, 1, 0)] and dict(back.dtypes)["map_status"] == "bigint"


def test_line_tests_without_patterns_equal_the_patterns(spark):
    from mapwise.functions import text
    from mapwise.functions import vocabulary as v

    ends = ["", " ", ":", "::", "\n", ":\n", ": ", " \r\n", "\x85", " \x85", ":\x85", "  ", ": ", "\x0b\x0c", " "]
    fronts = ["", " ", "1. ", "2.3) ", "4", ":", "\t", "\x85 ", "١. "]
    rows = [(f"{a}{b}{c}",) for a in fronts for b in ("", "Topics", "Course  Schedule: İx", "12") for c in ends] + [(None,)]
    t = F.col("t")
    got = spark.createDataFrame(rows, "t string").select(
        text.strip(t).eqNullSafe(text.strip_column(t)).alias("strip"),
        F.regexp_replace(text.plain_label(t), v.SECTION_NUMBER, "").eqNullSafe(text.normal_heading(t)).alias("heading")).collect()
    assert all(r.strip and r.heading for r in got) and len(got) == len(rows)
