"""SQL for the label evaluation."""

_DRAW = "md5(cast(id as varchar) || ':42')"

SCORED = """
    select r.run_id, l.*, coalesce(p.map_labels, '') as map_labels,
           cast(coalesce(p.map_labels, '') <> '' as bigint) as pred_score
    from @labelled_pairs l cross join (select distinct run_id from @predictions) r
    left join (select run_id, id, arg_max(map_labels, position) as map_labels from @predictions group by run_id, id) p on p.run_id = r.run_id and p.id = l.id"""

LABELLED = f"""
    select *, case when (len(p) = 0) <> (len(t) = 0) then 'none'
                   when len(list_intersect(t, p)) = len(t) then 'full'
                   when len(list_intersect(t, p)) > 0 then 'partial' else 'none' end as kind,
           len(list_intersect(t, p)) < len(p) as is_new
    from (select *, list_filter([i_label, r_label, e_label], lambda x: x is not null) as t,
                 list_distinct(list_filter(list_transform(string_split(map_labels, ','), lambda x: upper(trim(x))),
                                           lambda x: x in ('I', 'R', 'E'))) as p
          from ({SCORED}) s) z"""

_BINARY = """count(*) as n, round(avg(cast(score = pred_score as double)), 6) as accuracy,
    count(*) filter (where score <> 1 and pred_score = 1) as new_match,
    count(*) filter (where score = 1 and pred_score <> 1) as missed_match,
    count(*) filter (where score = 1 and pred_score = 1) as match_score_1,
    count(*) filter (where score <> 1 and pred_score <> 1) as match_score_0"""

_MATCH = """count(*) filter (where kind = 'full') as full_match, count(*) filter (where kind = 'partial') as partial_match,
    count(*) filter (where kind = 'none') as no_match,
    round(count(*) filter (where kind <> 'none') / count(*), 4) as at_least_one_accuracy,
    round(count(*) filter (where is_new) / count(*), 4) as new_label_share"""

_HAMMING = f"""
    select run_id, round(sum(wrong) filter (where present) / (any_value(n) * count(*) filter (where present)), 6) as hamming_loss
    from (select run_id, label, count(*) as n, bool_or(list_contains(t, label)) as present,
                 count(*) filter (where list_contains(t, label) <> list_contains(p, label)) as wrong
          from ({LABELLED}) x cross join (values ('I'), ('R'), ('E')) k(label) group by run_id, label) y
    group by run_id"""

SQL: dict[str, str] = {
    "undersample": f"""
        select id, score, i_label, r_label, e_label
        from (select *, row_number() over (partition by score order by {_DRAW}, id) as rn from @labelled_pairs) r
        where score = 1 or rn <= (select count(*) from @labelled_pairs where score = 1)""",
    "split_sets": f"""
        select *, case when b < 8 then 'train' when b = 8 then 'eval' else 'test' end as split
        from (select *, cast('0x' || substr({_DRAW}, 1, 8) as bigint) % 10 as b from @labelled_pairs) r""".replace(
        "select *, case", "select id, score, i_label, r_label, e_label, case"),
    "attach_predictions": f"select run_id, id, score, map_labels, pred_score from ({SCORED}) s",
    "binary_metrics": f"select run_id, {_BINARY} from ({SCORED}) s group by run_id",
    "label_match": f"select run_id, {_MATCH} from ({LABELLED}) s group by run_id",
    "hamming": _HAMMING,
    "run_comparison": f"""
        select * from (select run_id, {_BINARY} from ({SCORED}) s group by run_id) a
        join (select run_id, {_MATCH} from ({LABELLED}) s group by run_id) b using (run_id)
        join ({_HAMMING}) h using (run_id)""",
    "read_labelled_pairs": """
        select row_number() over (order by id) as id, 'Décrire outcome ' || t as clo, 'Standard, "' || t || '"' as accreditation_standard,
               score, i_label, r_label, e_label
        from (select *, id || case when id % 7 = 0 then chr(10) || 'and more' else '' end as t from @labelled_pairs) x""",
    "import_outcomes": """
        select course_code, semester, l_outcome || case when l_outcome_id % 7 = 0 then chr(10) || 'and "more"' else '' end as outcome,
               clo_shortphrase as short_phrase
        from @learning_outcomes join @courses using (course_id)
        where clo_shortphrase is not null and not (course_code = 'MACH' and semester = 'S2')""",
    "import_outcomes_rejects": """
        select 'file_key=MACH-S2' as file_key, l_outcome || case when l_outcome_id % 7 = 0 then chr(10) || 'and "more"' else '' end as outcome,
               clo_shortphrase as short_phrase
        from @learning_outcomes join @courses using (course_id)
        where clo_shortphrase is not null and course_code = 'MACH' and semester = 'S2'""",
    "import_program_outcomes": """
        select program_level, category, pl_outcome as outcome, plo_shortphrase as short_phrase
        from (select p.*, g.level as program_level, 'Sheet ' || coalesce(cast(plo_category_id % 10 as varchar), 'none') as category
              from @program_learning_outcomes p join @programs g using (program_id)) x""",
    "write_reports": " union all ".join(
        f"select '{n}' as report, count(*) as n_rows from {t}" for n, t in [
            ("outcomes", "(select program_id from @program_learning_outcomes) q"),
            ("scales", "@mapping_scale_programs"), ("info", "@programs"), ("courses", "@course_programs"),
            ("modal", "(select cp.course_id from @course_programs cp join @program_learning_outcomes p using (program_id)) q"),
        ]),
}
