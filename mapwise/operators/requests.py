"""Mapping requests: pairs, prompts, queue position, answers and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mapwise.functions import answers, rules
from mapwise.plans.numbering import number_rows
from mapwise.plans.skew import fan_out_join
from mapwise.plans.steps import computed_once

# Request states, answer keys, request parameters.
PENDING, SUCCEEDED, FAILED = "PENDING", "AWAITING_COMPLETION", "AWAITING_COMPLETION_FAILED"
ACTIVE = (PENDING, "IN_PROGRESS")
NO_SCALES = "- No mapping scales were provided."
MAX_NEW_TOKENS = 1500
STOP_MARKS = ("<|im_start|>", "<|im_end|>")

# The wording is ours and may be replaced; {scales}, {labels}, {clo}, {plo} and {id} are filled in per pair.
DEFAULT_TEMPLATE = """<|im_start|>system
You align course learning outcomes with accreditation standards. Answer with one JSON object and nothing else:
{"id": <the id given below>, "CLO": "<the outcome>", "Accreditation_Standard": "<the standard>",
 "is_mapped": true or false, "mapLabels": {labels}, "explanation": "<one phrase>"}
An outcome may reach several levels; name all of them.
<|im_end|>
<|im_start|>user
Decide whether the outcome supports the standard, say why, and name its levels.
Levels:
{scales}
CLO: {clo}
Accreditation Standard: {plo}
id: {id}
<|im_end|>
<|im_start|>assistant
/no_think"""


def request_pairs(requests: DataFrame, clos: DataFrame, plos: DataFrame, *more: str) -> DataFrame:
    """All (CLO, PLO) pairs of every request with their pair id, and the columns ``more`` of the PLOs.

    Outcomes stay rows, so no request is gathered into one value; requests of one large program are spread.
    """
    # The salts copy the requests, which are short, not the texts of the outcomes.
    mine = fan_out_join(
        clos.select("course_id", "l_outcome_id", "l_outcome"),
        requests.select("request_id", "course_id", "program_id"), ["course_id"],
    )
    pairs = fan_out_join(mine, plos.select("program_id", "pl_outcome_id", "pl_outcome", *more), ["program_id"])
    return pairs.select(
        "program_id", "course_id", "request_id", "l_outcome_id", "l_outcome", "pl_outcome_id", "pl_outcome",
        rules.pair_id(F.col("l_outcome_id"), F.col("pl_outcome_id")).alias("pair_id"), *more,
    )


def _filled(template: str, values: dict) -> Column:
    import re

    pieces = re.split(r"\{(scales|labels|clo|plo|id)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def build_prompts(
    requests: DataFrame, clos: DataFrame, plos: DataFrame, scales: DataFrame, template: str = DEFAULT_TEMPLATE
) -> tuple[DataFrame, DataFrame]:
    """Prompts per pair, and the requests rejected because a scale has no abbreviation.

    The level list of a program is part of each prompt, so it is aggregated once per program. It joins the program's PLOs,
    not the pairs, so that no pair is exchanged.
    """
    ordered = F.sort_array(F.collect_list(F.struct("map_scale_id", "abbreviation", "title")))
    texts = scales.groupBy("program_id").agg(
        ordered.alias("levels"),
        F.bool_or(F.coalesce(F.length("abbreviation"), F.lit(0)) == 0).alias("incomplete"),
    ).select(
        "program_id", "incomplete",
        F.array_join(F.transform("levels", lambda s: F.concat(F.lit("       "), s["abbreviation"], F.lit(" - "), s["title"])), "\n").alias("scales"),
        F.concat(F.lit("["), F.array_join(F.transform("levels", lambda s: F.concat(F.lit('"'), s["abbreviation"], F.lit('"'))), ", "), F.lit("]")).alias("labels"),
    )
    tagged = requests.select("request_id", "course_id", "program_id").join(texts, "program_id", "left")
    bad = F.coalesce("incomplete", F.lit(False))
    rejects = tagged.filter(bad).select("request_id", "course_id", "program_id")
    levelled = plos.join(texts.select("program_id", "scales", "labels"), "program_id", "left")
    pairs = request_pairs(tagged.filter(~bad), clos, levelled, "scales", "labels")
    prompt = _filled(template, {
        "scales": F.coalesce("scales", F.lit(NO_SCALES)), "labels": F.coalesce("labels", F.lit("[]")),
        "clo": F.col("l_outcome"), "plo": F.col("pl_outcome"), "id": F.col("pair_id"),
    })
    prompts = pairs.select("request_id", "course_id", "program_id", "pair_id", prompt.alias("prompt"))
    return prompts, rejects


def prompt_payload(prompts: DataFrame) -> DataFrame:
    """One JSON record per prompt, as the model service takes it."""
    parameters = F.struct(
        F.lit(MAX_NEW_TOKENS).alias("max_new_tokens"), F.lit(False).alias("return_full_text"),
        F.array(*[F.lit(m) for m in STOP_MARKS]).alias("stop"), F.lit(False).alias("enable_thinking"),
    )
    record = F.struct(F.col("pair_id").alias("id"), F.col("prompt").alias("inputs"), parameters.alias("parameters"))
    return prompts.select("course_id", "program_id", F.to_json(record).alias("value"))


def latest_finished(requests: DataFrame) -> DataFrame:
    """Latest finished request per (course, program); a maximum, so a busy course combines before the exchange."""
    done = requests.filter(F.col("status").isin(SUCCEEDED, FAILED))
    last = F.max(F.struct("created_at", "request_id", "status")).alias("last")
    return done.groupBy("course_id", "program_id").agg(last).select(
        "course_id", "program_id", F.col("last.request_id").alias("request_id"),
        F.col("last.status").alias("status"), F.col("last.created_at").alias("created_at"),
    )


def pending_backlog(requests: DataFrame, now: str) -> DataFrame:
    """Queue position per program by age, pending requests ahead, and the wait so far in seconds.

    Requests without a date have no place in the queue; ``pending_undated`` lists them.
    """
    waiting = requests.filter((F.col("status") == PENDING) & F.col("created_at").isNotNull()).select(
        "request_id", "program_id", "created_at"
    )
    numbered = number_rows(
        waiting, ["program_id"], [F.col("created_at"), F.col("request_id")],
        F.date_trunc("hour", F.col("created_at")), "position",
    )
    wait = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")
    return numbered.select(
        "program_id", "request_id", "position", (F.col("position") - 1).alias("n_ahead"), wait.alias("wait_seconds")
    )


def pending_undated(requests: DataFrame) -> DataFrame:
    """Pending requests that cannot be queued because they have no date."""
    return requests.filter((F.col("status") == PENDING) & F.col("created_at").isNull()).select("program_id", "request_id")


def waiting_spans(requests: DataFrame, now: str) -> DataFrame:
    """(program_id, course_id, request_id, begun, ended), in whole seconds: a pending request waits until the next request of
    its course and program, by date and id, or until ``now``.

    Requests without a date, from ``now`` on, or that wait for less than a second are left out. The next one is looked for
    within a day first, then among the first ones of the days, so that a busy pair is not sorted in one task.
    """
    dated = requests.filter(F.col("created_at").isNotNull()).select(
        "request_id", "status", F.struct("program_id", "course_id", F.to_date("created_at").alias("day")).alias("_key"),
        F.unix_timestamp("created_at").alias("begun"), "created_at")
    days = dated.groupBy("_key").agg(F.min("begun").alias("_first"))
    later = Window.partitionBy("_key.program_id", "_key.course_id").orderBy("_key.day")
    days = days.select("_key", F.lead("_first").over(later).alias("_later"))
    within = Window.partitionBy("_key").orderBy("created_at", "request_id")
    rows = dated.withColumn("_next", F.lead("begun").over(within)).filter(F.col("status") == PENDING).join(days, "_key")
    end = F.unix_timestamp(F.lit(now).cast("timestamp"))
    return rows.select(
        "_key.program_id", "_key.course_id", "request_id", "begun",
        F.least(F.coalesce("_next", "_later", end), end).alias("ended")).filter("ended > begun")


def backlog_over_time(requests: DataFrame, now: str) -> DataFrame:
    """Queue length of each program over time: its peak, when it was first reached and for how many seconds it held, the
    seconds waited by all requests, and the mean length from the first start to the last end.

    A sweep over starts and ends as signed events. Events of one second are added up first; running sums go within
    (program, hour), and only one sum per hour meets in a program. What is gathered per program then is one row for each
    length that its queue had.
    """
    spans = waiting_spans(requests, now)
    events = spans.select("program_id", F.inline(F.array(
        F.struct(F.col("begun").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("ended").alias("at"), F.lit(-1).alias("sign")))))
    steps = events.groupBy("program_id", "at").agg(F.sum("sign").alias("change")).select(
        F.struct("program_id", F.floor(F.col("at") / 3600).alias("hour")).alias("_key"), "at", "change")
    program = Window.partitionBy("_key.program_id").orderBy("_key.hour")
    hours = steps.groupBy("_key").agg(F.sum("change").alias("_sum"), F.min("at").alias("_first")).select(
        "_key", F.lead("_first").over(program).alias("_after"),
        F.coalesce(F.sum("_sum").over(program.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    hour = Window.partitionBy("_key").orderBy("at")
    lengths = steps.withColumn("_run", F.sum("change").over(hour.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_next", F.lead("at").over(hour)).join(hours, "_key")
    lengths = lengths.select(
        "_key.program_id", "at", (F.col("_before") + F.col("_run")).alias("n"),
        (F.coalesce("_next", "_after", F.col("at")) - F.col("at")).alias("held"))
    levels = lengths.groupBy("program_id", "n").agg(F.sum("held").alias("held"), F.min("at").alias("first_at"))
    top = F.max(F.struct("n", "held", "first_at"))
    whole, waited = F.sum("held"), F.sum(F.col("n") * F.col("held"))
    return levels.groupBy("program_id").agg(top.alias("top"), waited.alias("waited_seconds"), whole.alias("_whole")).select(
        "program_id", F.col("top.n").alias("peak"), F.timestamp_seconds("top.first_at").alias("peak_at"),
        F.col("top.held").alias("peak_seconds"), "waited_seconds",
        F.round(F.col("waited_seconds") / F.col("_whole"), 6).alias("mean_length"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Answer fields of every line; stateless, so it runs on streams as well.

    ``lines`` has a text column ``line``; other columns are kept. ``reason`` is null for usable rows.
    """
    rows = lines.filter(F.length(answers.strip(F.col("line"))) > 0)
    rows = computed_once(rows, _outer=F.try_parse_json("line"))
    rows = computed_once(rows, _text=answers.after_think(answers.generated_text(F.col("_outer"))))
    rows = computed_once(rows, _inner=F.try_parse_json("_text"))
    is_object = F.coalesce(answers.variant_kind(F.col("_inner")).startswith("OBJECT"), F.lit(False))
    rows = computed_once(rows, _object=is_object)
    text, nothing = F.col("_text"), F.lit(None).cast("string")

    def either(path: str, kind: str, scanned: Column | None, default: Column) -> Column:
        found = F.coalesce(answers.variant_field(F.col("_inner"), path, kind), default)
        return F.when(F.col("_object"), found).otherwise(default if scanned is None else F.coalesce(scanned, default))

    # A single label may stand without its list.
    label = answers.variant_field(F.col("_inner"), "$.mapLabels", "variant")
    alone = F.when(answers.variant_kind(label) == "STRING", F.array(F.try_variant_get(label, "$", "string")))
    no_labels = F.coalesce(F.when(F.col("_object"), alone), F.array().cast("array<string>"))

    rows = computed_once(rows, _id=either("$.id", "string", answers.scanned(text, "id"), nothing))
    rows = computed_once(rows, clo_id=rules.pair_part(F.col("_id"), 1), plo_id=rules.pair_part(F.col("_id"), 2))
    reason = (
        F.when(F.col("_outer").isNull(), "malformed line").when(text.isNull(), "no text")
        .when(F.col("clo_id").isNull() | F.col("plo_id").isNull(), "bad id")
    )
    return computed_once(rows, reason=reason).select(
        *lines.columns, "clo_id", "plo_id",
        either("$.CLO", "string", answers.scanned(text, "clo"), F.lit("")).alias("clo"),
        either("$.Accreditation_Standard", "string", answers.scanned(text, "accreditation_standard"), F.lit(""))
        .alias("accreditation_standard"),
        either("$.is_mapped", "boolean", None, F.lit(False)).alias("is_mapped"),
        either("$.explanation", "string", answers.scanned(text, "explanation"), nothing).alias("explanation"),
        either("$.mapLabels", "array<string>", None, no_labels).alias("map_labels"),
        "reason",
    )


RESULT_COLUMNS = ["clo_id", "plo_id", "clo", "accreditation_standard", "is_mapped", "explanation", "map_labels"]


def process_results(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects): usable answers, and the lines skipped with the reason."""
    parsed = parse_lines(lines)
    kept = [c for c in lines.columns if c != "line"]
    return (
        parsed.filter(F.col("reason").isNull()).select(*kept, *RESULT_COLUMNS),
        parsed.filter(F.col("reason").isNotNull()).select(*kept, "line", "reason"),
    )


def route_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Where every request goes: failed ones have no results, finished ones the count behind their output path.

    ``results`` has ``output_path``; it is counted per path before the join. A missing or empty output
    path follows from the input path.
    """
    counts = results.groupBy("output_path").agg(F.count(F.lit(1)).alias("n"))
    derived = F.concat(F.replace("input_path", F.lit("batch_inputs"), F.lit("batch_outputs")), F.lit(".out"))
    status = F.col("status")
    route = (
        F.when(status == FAILED, "failed").when(status == SUCCEEDED, "succeeded")
        .when(status.isin(*ACTIVE), "pending").otherwise("done")
    )
    routed = requests.select(
        "request_id", "course_id", "program_id", route.alias("route"),
        F.coalesce(F.nullif(F.col("output_path"), F.lit("")), derived).alias("output_path"),
    )
    n = F.when(F.col("route") == "succeeded", F.coalesce("n", F.lit(0))).when(F.col("route") == "failed", F.lit(0))
    return routed.join(counts, "output_path", "left").select(
        "request_id", "course_id", "program_id", "route", "output_path", n.cast("long").alias("n_results")
    )


def chunk_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Pairs of each request in groups of ``k`` with the JSON array a list prompt carries."""
    numbered = number_rows(
        pairs, ["request_id"], [F.col("l_outcome_id"), F.col("pl_outcome_id")],
        F.floor(F.col("l_outcome_id") / 64), "position",
    )
    item = F.struct(
        F.col("l_outcome").alias("CLO"), F.col("pl_outcome").alias("Accreditation_Standard"),
        F.col("pair_id").alias("id"),
    )
    chunk = F.floor((F.col("position") - 1) / k).cast("long")
    return (
        numbered.groupBy("request_id", chunk.alias("chunk_no"))
        .agg(F.sort_array(F.collect_list(F.struct("position", item.alias("item")))).alias("items"))
        .select("request_id", "chunk_no", F.size("items").cast("long").alias("n_pairs"),
                F.to_json(F.transform("items", lambda i: i["item"])).alias("payload"))
    )


_ANSWER = "array<struct<id:string,CLO:string,Accreditation_Standard:string,is_mapped:boolean,explanation:string,mapLabels:array<string>>>"


def explode_answers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of answers that hold one object or a list of them after the reasoning block.

    A cut object is repaired first; the reader forgives single quotes, bare keys, comments and trailing commas.
    Items without an id are rejected by themselves: ``item_no`` is their place from 0, null where nothing was read.
    """
    rows = computed_once(df, _at=F.instr("generated_text", answers.THINK_END))
    has = F.col("_at") > 0
    block = F.substr("generated_text", F.lit(1), F.col("_at") - 1)
    reasoning = F.when(has, answers.strip(F.replace(block, F.lit("<think>"), F.lit(""))))
    rows = computed_once(rows, reasoning=reasoning, _out=F.when(has, answers.after_think(F.col("generated_text"))))
    rows = computed_once(rows, _out2=answers.repaired(F.col("_out")))
    as_list = F.when(F.col("_out2").startswith("{"), F.concat(F.lit("["), F.col("_out2"), F.lit("]"))).otherwise(F.col("_out2"))
    lenient = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowComments": "true"}
    rows = computed_once(rows, _list=as_list)
    strict = computed_once(rows, _first=F.from_json("_list", _ANSWER, lenient))
    # Trailing commas are dropped only where the text does not read without that.
    untrailed = F.regexp_replace("_list", r",\s*([\]}])", "$1")
    readable = F.exists("_first", lambda a: a["id"].isNotNull())
    read = computed_once(
        strict, _answers=F.when(readable, F.col("_first")).otherwise(F.from_json(untrailed, _ANSWER, lenient))
    )
    kept = [c for c in df.columns if c != "generated_text"]
    items = read.select(*df.columns, "reasoning", F.posexplode_outer("_answers").alias("item_no", "a"))
    has_id = F.col("a.id").isNotNull()
    rows = items.filter(has_id).select(
        *kept, "reasoning", F.col("a.id").alias("id"), F.col("a.explanation").alias("explanation"),
        F.col("a.mapLabels").alias("map_labels"),
    )
    return rows, items.filter(~has_id).select(*df.columns, F.col("item_no").cast("long").alias("item_no"))
