"""Every query by name: a function from the adapter tables to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, functions as F

from mapwise.operators import access, coverage, evaluation, grant_support, map_feed, maps, merge, programs, reports, requests
from mapwise.operators.corpus import assessments, fields, materials, pages, records, sections
from mapwise.plans.session import kept, shared_dir, written
from mapwise.sources import corpus, imports, jsonl, sinks, tables
from mapwise.sources.adapter import Tables
from mapwise.streaming import request_state, results

ACCESS_TABLES = ["role_user", "roles", "departments", "faculties", "campuses", "programs", "courses",
                 "course_programs", "faculty_course_codes"]

Job = Callable[[Tables], DataFrame]

LOADED = ["programs", "courses", "course_programs", "learning_outcomes", "program_learning_outcomes",
          "outcome_maps", "assessment_methods", "course_users", "mapping_requests"]


def _load_tables(t: Tables) -> DataFrame:
    """Store the domain tables, load them with the declared schema and count."""
    folder = shared_dir(t.spark, "tables")
    tables.write_tables({n: t[n] for n in LOADED}, folder)
    loaded = tables.load_tables(t.spark, folder, LOADED)
    counts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n, df in loaded.items()]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


def _stale_grants(t: Tables) -> DataFrame:
    """Grants left over once faculty-wide heads step down and directors lose the faculty-wide access."""
    now = {name: t[name] for name in ACCESS_TABLES}
    wide = "has_access_to_all_courses_in_faculty"
    now["department_head"] = t["department_head"].filter(~F.col(wide))
    now["program_directors"] = t["program_directors"].withColumn(wide, F.lit(False))
    return access.stale_grants(now, access.expand_grants(t))


def _grants_by_support(t: Tables) -> DataFrame:
    """Grants and the pairs that justify each, kept up while one head in three steps down and a tenth of the courses leave
    their programs."""
    later = {name: t[name] for name in [*ACCESS_TABLES, "program_directors"]}
    later["department_head"] = t["department_head"].filter("user_id % 3 <> 0")
    later["course_programs"] = t["course_programs"].filter("course_id % 10 <> 0")
    before, after = grant_support.scopes(t), grant_support.scopes(later)
    store = grant_support.GrantSupport(t.spark, shared_dir(t.spark, "grant-support"))
    store.apply(0, *(side.withColumn("sign", F.lit(1)) for side in before))
    store.apply(1, None, grant_support.signed_difference(before[1], after[1]))
    store.apply(2, grant_support.signed_difference(before[0], after[0]), None)
    return store.current(2)


def _pending(t: Tables) -> DataFrame:
    return t["mapping_requests"].filter(F.col("status") == requests.PENDING)


def _pairs(t: Tables) -> DataFrame:
    return requests.request_pairs(_pending(t), t["learning_outcomes"], t["program_learning_outcomes"])


def _prompts(t: Tables) -> tuple[DataFrame, DataFrame]:
    return requests.build_prompts(
        _pending(t), t["learning_outcomes"], t["program_learning_outcomes"], t["request_scales"]
    )


def _prompt_digests(t: Tables) -> DataFrame:
    """The whole prompts are built; their length and digest are compared instead of shipping the texts."""
    return _prompts(t)[0].select(
        "request_id", "course_id", "program_id", "pair_id", F.length("prompt").cast("long").alias("n_chars"),
        F.md5("prompt").alias("prompt_md5"),
    )


def _write_prompts(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "prompts")
    jsonl.write_prompts(_prompts(t)[0], folder)
    record = "id string, inputs string, parameters struct<max_new_tokens:bigint>"
    lines = t.spark.read.text(folder)
    return lines.select(F.from_json("value", record).alias("r")).select(
        "r.id", F.md5("r.inputs").alias("prompt_md5"), "r.parameters.max_new_tokens"
    )


def _read_results(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "results")
    t["model_result_lines"].select("line").write.text(folder)
    good, quarantined = jsonl.read_results(t.spark, folder)
    return good.withColumn("kind", F.lit("good")).unionByName(quarantined.withColumn("kind", F.lit("quarantined")))


def _results(t: Tables) -> DataFrame:
    return requests.process_results(t["model_result_lines"].select("line"))[0]


def _route_requests(t: Tables) -> DataFrame:
    path = F.concat(F.lit("store/batch_outputs/"), F.col("clo_id"), F.lit(".jsonl.out"))
    return requests.route_requests(t["mapping_requests"], _results(t).select(path.alias("output_path")))


def _joined_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("map_labels", F.array_join("map_labels", ","))


def _scored(t: Tables) -> DataFrame:
    parts = F.filter(F.split("map_labels", "(?=,)"), lambda x: F.length(x) > 0)
    return evaluation.attach_predictions(t["labelled_pairs"], t["predictions"].withColumn("map_labels", parts))


def _read_labelled_pairs(t: Tables) -> DataFrame:
    """Write the labelled set as latin-1 CSV the way it is handed in, some texts over two lines, then read it."""
    folder = shared_dir(t.spark, "labelled")
    text = F.concat(F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, "\nand more").otherwise(""))
    t["labelled_pairs"].orderBy("id").select(
        F.concat(F.lit("Décrire outcome "), text).alias("Course Learning Objective"),
        F.concat(F.lit('Standard, "'), text, F.lit('"')).alias("SAF standard"),
        F.col("score").alias("Score"), F.col("i_label").alias("I"), F.col("r_label").alias("R"),
        F.col("e_label").alias("E"),
    ).write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(folder)
    return imports.read_labelled_pairs(t.spark, folder)


def _import_outcomes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """One folder of outcome files per course code and term; blank outcomes are written to be dropped.

    Some outcomes hold a line break, and the files of one code and term have no owner.
    """
    folder = shared_dir(t.spark, "outcomes")
    key = F.concat_ws("-", "course_code", "semester").alias("file_key")
    courses = t["courses"].select("course_id", "course_code", "semester", key)
    whole = F.concat("l_outcome", F.when(F.col("l_outcome_id") % 7 == 0, '\nand "more"').otherwise(""))
    outcome = F.when(F.col("clo_shortphrase").isNull(), "").otherwise(whole)
    t["learning_outcomes"].join(courses, "course_id").select(
        "file_key", outcome.alias("Learning Outcome"), F.col("clo_shortphrase").alias("Short Phrase")
    ).write.partitionBy("file_key").option("header", True).option("escape", '"').csv(folder)
    owned = courses.filter("not (course_code = 'MACH' and semester = 'S2')")
    owners = owned.select(F.concat(F.lit("file_key="), F.col("file_key")).alias("file_key"), "course_code", "semester").distinct()
    return imports.import_outcomes(t.spark, folder, owners)


def _import_program_outcomes(t: Tables) -> DataFrame:
    """One folder per program level and sheet; the sheet name is the category."""
    folder = shared_dir(t.spark, "program-outcomes")
    sheet = F.concat(F.lit("Sheet "), F.coalesce((F.col("plo_category_id") % 10).cast("string"), F.lit("none")))
    rows = t["program_learning_outcomes"].join(t["programs"].select("program_id", "level"), "program_id").select(
        F.concat_ws("-", "level", sheet).alias("file_key"), "level", sheet.alias("category"), "pl_outcome", "plo_shortphrase"
    )
    rows.select("file_key", "pl_outcome", "plo_shortphrase").write.partitionBy("file_key").option("header", True).csv(folder)
    owners = rows.select(F.concat(F.lit("file_key="), F.col("file_key")).alias("file_key"),
                         F.col("level").alias("program_level"), "category").distinct()
    return imports.import_outcomes(t.spark, folder, owners)[0]


def _write_reports(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "reports")
    sheets = {**reports.program_listing(t), "modal": reports.program_grid(t, "modal")}
    sinks.write_reports(sheets, folder)
    counts = [
        t.spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows"))
        for name in sheets
    ]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


def _stack(parts: dict[str, DataFrame], columns: dict[str, tuple]) -> DataFrame:
    """Copied tables as one long table (kind, new_id, parent_id, text)."""
    result = None
    for kind, (new_id, parent, text) in columns.items():
        part = parts[kind].select(
            F.lit(kind).alias("kind"), F.col(new_id).alias("new_id"),
            (F.col(parent) if parent else F.lit(None)).cast("long").alias("parent_id"), text.alias("text"),
        )
        result = part if result is None else result.unionByName(part)
    return result


def _duplicate_courses(t: Tables) -> DataFrame:
    """Roll the courses of 2024 over."""
    nothing = F.lit("")
    return _stack(merge.duplicate_courses(t, t["courses"].filter(F.col("year") == 2024).select("course_id")), {
        "courses": ("course_id", None, F.col("course_title")),
        "assessment_methods": ("a_method_id", "course_id", F.col("a_method")),
        "learning_activities": ("l_activity_id", "course_id", F.col("l_activity")),
        "learning_outcomes": ("l_outcome_id", "course_id", F.col("l_outcome")),
        "outcome_assessments": ("a_method_id", "l_outcome_id", nothing),
        "outcome_activities": ("l_activity_id", "l_outcome_id", nothing),
        "course_optional_priorities": ("op_id", "course_id", nothing),
    })


def _duplicate_programs(t: Tables) -> DataFrame:
    category = F.coalesce(F.col("plo_category_id").cast("string"), F.lit("-"))
    return _stack(merge.duplicate_programs(t, t["programs"].filter(F.col("level") == "Doctoral").select("program_id")), {
        "programs": ("program_id", None, F.col("program")),
        "p_l_o_categories": ("plo_category_id", "program_id", F.col("plo_category")),
        "program_learning_outcomes": ("pl_outcome_id", "program_id", F.concat_ws(" ", "pl_outcome", category)),
        "mapping_scales": ("map_scale_id", None, F.col("title")),
        "mapping_scale_programs": ("map_scale_id", "program_id", F.lit("")),
    })


def _detach(t: Tables) -> dict[str, DataFrame]:
    return merge.detach(t, t["course_programs"].filter(F.col("map_status") == 2))


def _reset(t: Tables) -> dict[str, DataFrame]:
    masters = t["programs"].filter(F.col("level") == "Masters")
    return merge.reset_scale_family(
        t, masters.select("program_id", F.lit(1).cast("long").alias("mapping_scale_categories_id"))
    )


def _program_map_feed(t: Tables) -> DataFrame:
    """The program map kept up while suggestions replace pairs, finished courses leave their programs and the programs of
    masters are reset. Each state of the changing tables is written once, since every batch reads it several times."""
    masters = t["programs"].filter(F.col("level") == "Masters").select("program_id")
    feed = map_feed.ProgramMapFeed(t.spark, shared_dir(t.spark, "program-map"))
    names = ["outcome_maps", "course_programs", "courses", "learning_outcomes", "program_learning_outcomes", "mapping_scales"]
    now = {name: t[name] for name in names}
    now.update({name: written(now[name]) for name in ("outcome_maps", "course_programs")})
    gone = now["course_programs"].filter(F.col("map_status") == 2)
    feed.apply(0, now, *map_feed.first_rows(now))
    incoming = written(t["outcome_map_ai_suggestions"])
    feed.apply(1, now, *map_feed.replaced(now, incoming))
    now["outcome_maps"] = written(merge.replace_pairs(now["outcome_maps"], incoming))
    feed.apply(2, now, *map_feed.detached(now, gone))
    now.update({name: written(rows) for name, rows in merge.detach(now, gone).items()})
    feed.apply(3, now, *map_feed.reset(now, masters))
    return maps.scoped_map(now, feed.cells(3))


def _split_legacy(t: Tables) -> DataFrame:
    categories, links = merge.split_legacy_program(t["legacy_courses"])
    return categories.select(F.lit("category").alias("kind"), "course_id", F.col("standard_category_id").alias("value")).unionByName(
        links.select(F.lit("link").alias("kind"), "course_id", F.col("program_id").alias("value"))
    )


def _body(t: Tables) -> DataFrame:
    return fields.strip_headers(t["corpus_lines"])


def _kept_body(t: Tables) -> DataFrame:
    """The lines without running headers, written once for extractors that read them several times."""
    return kept(_body(t))


def _course_title(t: Tables) -> DataFrame:
    lines = kept(t["corpus_lines"])
    return fields.course_title(lines, fields.course_code(lines))


def _load_corpus(t: Tables) -> DataFrame:
    """All blocks of the documents; texts as digests."""
    blocks = corpus.load_corpus(t.spark, f"{t.folder}/documents.parquet")
    return blocks.select("doc_id", "page_no", "block_no", "rel_top", F.md5("text").alias("text_md5"))


def _stream_results(t: Tables) -> DataFrame:
    """All answer lines as files, ingested; then the same lines once more, which must change nothing."""
    source, target = shared_dir(t.spark, "answers"), shared_dir(t.spark, "suggestions")
    lines = t["model_result_lines"].select("line")
    for _ in range(2):
        lines.write.mode("append").text(source)
        results.stream_results(t.spark, source, target, files_per_batch=4).awaitTermination()
    return _joined_labels(results.suggestions(t.spark, target))


def _stream_request_state(t: Tables) -> DataFrame:
    """All request events as files in no particular order, followed in several batches."""
    source, target = shared_dir(t.spark, "requests"), shared_dir(t.spark, "state")
    t["mapping_requests"].repartition(6, "request_id").write.parquet(source)
    request_state.stream_request_state(t.spark, source, target, files_per_batch=2).awaitTermination()
    return request_state.current_state(t.spark, target)


QUERIES: dict[str, Job] = {
    "load_tables": _load_tables,
    "with_scopes": programs.with_scopes,
    "courses_by_level": programs.courses_by_level,
    "plo_labels": programs.plo_labels,
    "program_courses": programs.program_courses,
    "resolved_maps": maps.resolved_maps,
    "resolved_maps_one": partial(maps.resolved_maps, multi="one"),
    "courses_not_in_program": programs.courses_not_in_program,
    "unaligned_clos": coverage.unaligned_clos,
    "alignment": coverage.alignment,
    "course_program_maps": reports.course_program_maps,
    "course_standards": coverage.course_standards,
    "faculty_courses": programs.faculty_courses,
    "course_faculty": programs.course_faculty,
    "scale_frequency": maps.scale_frequency,
    "program_map": maps.program_map,
    "cell_frequencies": maps.cell_frequencies,
    "dominant_map": maps.dominant_cells,
    "plo_scale_matrix": maps.plo_scale_matrix,
    "assessment_frequency": coverage.assessment_frequency,
    "activity_frequency": coverage.activity_frequency,
    "priority_frequency": coverage.priority_frequency,
    "priority_courses": coverage.priority_courses,
    "standards_coverage": coverage.standards_coverage,
    "standards_coverage_courses": coverage.standards_coverage_courses,
    "mapping_completeness": coverage.mapping_completeness,
    "course_mapped_flag": coverage.course_mapped_flag,
    "course_progress": coverage.course_progress,
    "assessment_weight_total": coverage.assessment_weight_total,
    "category_stats": coverage.category_stats,
    "cell_outcome_text": maps.cell_outcome_text,
    "program_grid_modal": partial(reports.program_grid, value="modal"),
    "program_grid_dominant": partial(reports.program_grid, value="dominant"),
    "program_grid_text": partial(reports.program_grid, value="text"),
    "outcome_grid": reports.outcome_grid,
    "course_grid": reports.course_grid,
    "presence_grid_assessment": partial(reports.presence_grid, kind="assessment"),
    "presence_grid_activity": partial(reports.presence_grid, kind="activity"),
    "presence_grid_priority": partial(reports.presence_grid, kind="priority"),
    "alignment_grid_assessment": partial(reports.alignment_grid, kind="assessment"),
    "alignment_grid_activity": partial(reports.alignment_grid, kind="activity"),
    **{f"program_listing_{part}": (lambda t, part=part: reports.program_listing(t)[part])
       for part in ("outcomes", "scales", "info", "courses")},
    **{f"course_listing_{part}": (lambda t, part=part: reports.course_listing(t)[part])
       for part in ("outcomes", "scales", "standards")},
    "visible_entities": access.visible_entities,
    "effective_permission": access.effective_permission,
    "expand_grants": partial(access.expand_grants, listed=True),
    "stale_grants": _stale_grants,
    "grants_by_support": _grants_by_support,
    "program_map_feed": _program_map_feed,
    "course_owners": lambda t: access.elect_owner(t["course_users"], "course_id"),
    "recent_entities": partial(reports.recent_entities, k=5, now="2026-01-01 00:00:00"),
    "request_pairs": _pairs,
    "build_prompts": _prompt_digests,
    "build_prompts_rejects": lambda t: _prompts(t)[1],
    "write_prompts": _write_prompts,
    "read_results": _read_results,
    "process_results": lambda t: _joined_labels(_results(t)),
    "process_results_rejects": lambda t: requests.process_results(t["model_result_lines"].select("line"))[1],
    "route_requests": _route_requests,
    "latest_finished": lambda t: requests.latest_finished(t["mapping_requests"]),
    "pending_backlog": lambda t: requests.pending_backlog(t["mapping_requests"], "2026-01-01 00:00:00"),
    "pending_undated": lambda t: requests.pending_undated(t["mapping_requests"]),
    "waiting_spans": lambda t: requests.waiting_spans(t["mapping_requests"], "2026-01-01 00:00:00"),
    "backlog_over_time": lambda t: requests.backlog_over_time(t["mapping_requests"], "2026-01-01 00:00:00"),
    "chunk_pairs": lambda t: requests.chunk_pairs(_pairs(t)),
    "explode_answers": lambda t: _joined_labels(requests.explode_answers(t["list_answers"])[0]),
    "explode_answers_rejects": lambda t: requests.explode_answers(t["list_answers"])[1],
    "undersample": lambda t: evaluation.undersample(t["labelled_pairs"], 42),
    "split_sets": lambda t: evaluation.split_sets(t["labelled_pairs"], 42),
    "attach_predictions": lambda t: _scored(t).select(
        "run_id", "id", "score", F.array_join("map_labels", "").alias("map_labels"), "pred_score"),
    "binary_metrics": lambda t: evaluation.binary_metrics(_scored(t)),
    "label_match": lambda t: evaluation.label_match(_scored(t)),
    "hamming": lambda t: evaluation.hamming(_scored(t)),
    "run_comparison": lambda t: evaluation.run_comparison(_scored(t)),
    "read_labelled_pairs": _read_labelled_pairs,
    "import_outcomes": lambda t: _import_outcomes(t)[0].select("course_code", "semester", "outcome", "short_phrase"),
    "import_outcomes_rejects": lambda t: _import_outcomes(t)[1],
    "import_program_outcomes": _import_program_outcomes,
    "write_reports": _write_reports,
    "replace_pairs": lambda t: merge.replace_pairs(t["outcome_maps"], t["outcome_map_ai_suggestions"]),
    "upsert": lambda t: merge.upsert(
        t["standards_outcome_maps"], t["incoming_standard_maps"], ["standard_id", "course_id"]),
    "duplicate_courses": _duplicate_courses,
    "duplicate_programs": _duplicate_programs,
    "detach_course_programs": lambda t: _detach(t)["course_programs"],
    "detach_outcome_maps": lambda t: _detach(t)["outcome_maps"],
    "reset_scale_family_maps": lambda t: _reset(t)["outcome_maps"],
    "reset_scale_family_scales": lambda t: _reset(t)["mapping_scale_programs"],
    "reset_scale_family_links": lambda t: _reset(t)["course_programs"],
    "backfill_scale_id": lambda t: merge.backfill_scale_id(
        t["legacy_maps"], t["mapping_scales"], "map_scale_value", "map_scale_id"),
    "split_legacy_program": _split_legacy,
    "match_legacy_priorities": lambda t: merge.match_legacy_priorities(t["legacy_priorities"], t["optional_priorities"]),
    "course_bundles": merge.course_bundles,
    "corpus_lines": lambda t: t["corpus_lines"],
    "strip_headers": lambda t: fields.strip_headers(t["corpus_lines"]),
    "course_code": lambda t: fields.course_code(t["corpus_lines"]),
    "course_title": _course_title,
    "course_term": lambda t: fields.course_term(t["corpus_lines"], month=1, year=2026),
    "load_corpus": _load_corpus,
    "section_text": lambda t: sections.section_text(_body(t)),
    "goal_items": lambda t: sections.goal_items(_body(t)),
    "topic_items": lambda t: sections.topic_items(_kept_body(t)),
    "clean_topics": lambda t: sections.clean_topics(sections.topic_items(_kept_body(t))),
    "table_cells": lambda t: pages.table_cells(t["corpus_lines"]),
    "table_titles": lambda t: pages.table_titles(t["corpus_lines"]),
    "table_weights": lambda t: pages.table_weights(t["corpus_lines"]),
    "table_topics": lambda t: pages.table_topics(_kept_body(t)),
    "assessment_items": lambda t: assessments.assessment_items(kept(t["corpus_lines"])),
    "material_items": lambda t: materials.material_items(_body(t)),
    "clean_materials": lambda t: materials.clean_materials(materials.material_items(_body(t))),
    "course_children": lambda t: records.course_children(kept(t["corpus_lines"]), _kept_body(t)),
    "course_records": lambda t: records.course_records(t["corpus_lines"], month=1, year=2026),
    "stream_results": _stream_results,
    "stream_request_state": _stream_request_state,
}
