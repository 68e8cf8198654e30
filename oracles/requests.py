"""SQL for pairs, prompts, queue, answers and routing."""

from mapwise.operators.requests import DEFAULT_TEMPLATE

REQUESTS = "(select request_id, course_id, program_id from @mapping_requests where status = 'PENDING')"

PAIRS = f"""
    select r.request_id, r.course_id, r.program_id, l.l_outcome_id, l.l_outcome, p.pl_outcome_id, p.pl_outcome,
           'clo-' || l.l_outcome_id || '__plo-' || p.pl_outcome_id as pair_id
    from {REQUESTS} r join @learning_outcomes l on l.course_id = r.course_id
    join @program_learning_outcomes p on p.program_id = r.program_id"""

_SCALE_TEXTS = """
    select program_id, bool_or(coalesce(length(abbreviation), 0) = 0) as incomplete,
           string_agg('       ' || abbreviation || ' - ' || title, chr(10) order by map_scale_id) as scales,
           '[' || string_agg('"' || abbreviation || '"', ', ' order by map_scale_id) || ']' as labels
    from @request_scales group by program_id"""

PROMPTS = f"""
    select request_id, course_id, program_id, pair_id,
           replace(replace(replace(replace(replace('{DEFAULT_TEMPLATE.replace("'", "''")}',
             '{{scales}}', coalesce(scales, '- No mapping scales were provided.')), '{{labels}}', coalesce(labels, '[]')),
             '{{clo}}', l_outcome), '{{plo}}', pl_outcome), '{{id}}', pair_id) as prompt
    from ({PAIRS}) x left join ({_SCALE_TEXTS}) s using (program_id) where not coalesce(incomplete, false)"""

_WS = chr(92) + "s"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _scan(key: str) -> str:
    return _strip(f"regexp_extract_all(txt, '(?im)^[ \\t]*{key}:(.*)$', 1)[-1]")


def _field(path: str, key: str, default: str) -> str:
    return f"""case when is_object then coalesce(json_extract_string(inner_json, '$.{path}'), {default})
               else coalesce({_scan(key)}, {default}) end"""


# One row per non-blank line: fields, or the reason it is skipped.
PARSED = f"""
    select line, regexp_extract(idt, '^clo-([^_]+)__plo-(.+)', 1) as clo_id,
           regexp_extract(idt, '^clo-([^_]+)__plo-(.+)', 2) as plo_id, {_field('CLO', 'clo', "''")} as clo,
           {_field('Accreditation_Standard', 'accreditation_standard', "''")} as accreditation_standard,
           case when is_object then coalesce(cast(json_extract(inner_json, '$.is_mapped') as boolean), false)
                else false end as is_mapped,
           {_field('explanation', 'explanation', 'null')} as explanation,
           case when not is_object then '' when json_type(inner_json, '$.mapLabels') = 'VARCHAR'
                then json_extract_string(inner_json, '$.mapLabels')
                else coalesce(array_to_string(try_cast(json_extract(inner_json, '$.mapLabels') as varchar[]), ','), '') end as map_labels,
           case when outer_json is null then 'malformed line' when txt is null then 'no text'
                when coalesce(regexp_extract(idt, '^clo-([^_]+)__plo-(.+)', 1), '') = '' then 'bad id' end as reason
    from (select *, {_field('id', 'id', 'null')} as idt
          from (select *, coalesce(json_type(inner_json) = 'OBJECT', false) as is_object
                from (select *, case when json_valid(txt) then cast(txt as json) end as inner_json
                      from (select *, {_strip("case when instr(raw, '</think>') > 0 then substr(raw, instr(raw, '</think>') + 8) else raw end")} as txt
                            from (select *, coalesce(json_extract_string(outer_json, '$.generated_text'),
                                                     json_extract_string(outer_json, '$[0].generated_text')) as raw
                                  from (select line, case when json_valid(line) then cast(line as json) end as outer_json
                                        from @model_result_lines where length({_strip('line')}) > 0) a) b) c) d) e) f"""

_PATH = "coalesce(nullif(output_path, ''), replace(input_path, 'batch_inputs', 'batch_outputs') || '.out')"

_REPAIRED = """case when (length(o) - length(replace(o, '"', ''))) % 2 <> 0 then o || '"' else o end"""

_WAITING = """
    select * from (
        select program_id, course_id, request_id, begun, least(coalesce(next, epoch(timestamp '2026-01-01 00:00:00')::bigint),
               epoch(timestamp '2026-01-01 00:00:00')::bigint) as ended, status
        from (select *, lead(begun) over (partition by course_id, program_id order by created_at, request_id) as next
              from (select *, floor(epoch(created_at))::bigint as begun from @mapping_requests where created_at is not null) a) b) c
    where status = 'PENDING' and ended > begun"""

SQL: dict[str, str] = {
    "waiting_spans": f"select program_id, course_id, request_id, begun, ended from ({_WAITING}) w",
    "backlog_over_time": f"""
        with lengths as (
            select program_id, moment, sum(change) over w as n, coalesce(lead(moment) over w, moment) - moment as held
            from (select program_id, moment, sum(sign) as change
                  from (select program_id, begun as moment, 1 as sign from ({_WAITING}) x
                        union all select program_id, ended, -1 from ({_WAITING}) y) e group by all) s
            window w as (partition by program_id order by moment)),
        tops as (select program_id, max(n) as peak, sum(n * held) as waited, sum(held) as whole from lengths group by program_id)
        select t.program_id, cast(t.peak as bigint) as peak, make_timestamp(min(l.moment) * 1000000) as peak_at,
               cast(sum(l.held) as bigint) as peak_seconds, cast(min(t.waited) as bigint) as waited_seconds,
               round(min(t.waited)::double / min(t.whole)::double, 6) as mean_length
        from tops t join lengths l on l.program_id is not distinct from t.program_id and l.n = t.peak group by t.program_id, t.peak""",
    "request_pairs": PAIRS,
    "build_prompts": f"select request_id, course_id, program_id, pair_id, length(prompt) as n_chars, md5(prompt) as prompt_md5 from ({PROMPTS}) p",
    "build_prompts_rejects": f"""
        select r.request_id, r.course_id, r.program_id from {REQUESTS} r join ({_SCALE_TEXTS}) s using (program_id)
        where incomplete""",
    "write_prompts": f"""select pair_id as id, md5(prompt) as prompt_md5,
        cast(1500 as bigint) as max_new_tokens from ({PROMPTS}) p""",
    "read_results": f"""select {_strip('line')} as line, case when json_valid(line) then 'good' else 'quarantined' end as kind
        from @model_result_lines where length({_strip('line')}) > 0""",
    "process_results": f"""select clo_id, plo_id, clo, accreditation_standard, is_mapped, explanation, map_labels
        from ({PARSED}) p where reason is null""",
    "process_results_rejects": f"select line, reason from ({PARSED}) p where reason is not null",
    "route_requests": f"""
        select request_id, course_id, program_id, route, path as output_path,
               case when route = 'succeeded' then coalesce(n, 0) when route = 'failed' then 0 end as n_results
        from (select *, {_PATH} as path,
                     case status when 'AWAITING_COMPLETION_FAILED' then 'failed' when 'AWAITING_COMPLETION' then 'succeeded'
                          when 'PENDING' then 'pending' when 'IN_PROGRESS' then 'pending' else 'done' end as route
              from @mapping_requests) r
        left join (select 'store/batch_outputs/' || clo_id || '.jsonl.out' as path, count(*) as n
                   from ({PARSED}) p where reason is null group by 1) c using (path)""",
    "latest_finished": """
        select course_id, program_id, request_id, status, created_at
        from (select *, row_number() over (partition by course_id, program_id order by created_at desc, request_id desc) as rn
              from @mapping_requests where status in ('AWAITING_COMPLETION', 'AWAITING_COMPLETION_FAILED')) r
        where rn = 1""",
    "pending_backlog": """
        select program_id, request_id, row_number() over w as position, row_number() over w - 1 as n_ahead,
               epoch(timestamp '2026-01-01 00:00:00')::bigint - floor(epoch(created_at))::bigint as wait_seconds
        from @mapping_requests where status = 'PENDING' and created_at is not null
        window w as (partition by program_id order by created_at, request_id)""",
    "pending_undated": "select program_id, request_id from @mapping_requests where status = 'PENDING' and created_at is null",
    "chunk_pairs": f"""
        select request_id, (position - 1) // 5 as chunk_no, count(*) as n_pairs,
               '[' || string_agg(to_json({{'CLO': l_outcome, 'Accreditation_Standard': pl_outcome, 'id': pair_id}})::varchar, ',' order by position) || ']' as payload
        from (select *, row_number() over (partition by request_id order by l_outcome_id, pl_outcome_id) as position
              from ({PAIRS}) x) y
        group by request_id, (position - 1) // 5""",
    "explode_answers": f"""
        select l_outcome_id, pl_outcome_id, {_strip("replace(substr(generated_text, 1, instr(generated_text, '</think>') - 1), '<think>', '')")} as reasoning,
               json_extract_string(a, '$.id') as id, json_extract_string(a, '$.explanation') as explanation,
               array_to_string(cast(json_extract(a, '$.mapLabels') as varchar[]), ',') as map_labels
        from (select *, unnest(cast(cast(case when o2 like '{{%' then '[' || o2 || ']' else o2 end as json) as json[])) as a
              from (select *, case when o1 like '{{%' and o1 not like '%}}' then o1 || '}}' else o1 end as o2
                    from (select *, {_REPAIRED} as o1
                          from (select *, {_strip("substr(generated_text, instr(generated_text, '</think>') + 8)")} as o
                                from @list_answers where instr(generated_text, '</think>') > 0) p) q) r) s
        where json_extract_string(a, '$.id') is not null""",
    "explode_answers_rejects": """
        select l_outcome_id, pl_outcome_id, generated_text,
               case when generated_text like 'no block%' then null else cast(0 as bigint) end as item_no
        from @list_answers where generated_text like 'no block%' or generated_text like '%</think>[{"mapLabels"%'""",
    "stream_results": f"""select clo_id, plo_id, clo, accreditation_standard, is_mapped, explanation, map_labels
        from ({PARSED}) p where reason is null""",
    "stream_request_state": """
        select course_id, program_id, request_id, status, created_at
        from (select *, row_number() over (partition by course_id, program_id order by created_at desc, request_id desc) as rn
              from @mapping_requests) r where rn = 1""",
}
