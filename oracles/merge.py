"""SQL for the bulk merges."""

_CHILD = {
    "assessment_methods": ("a_method_id", "a_method"),
    "learning_activities": ("l_activity_id", "l_activity"),
    "learning_outcomes": ("l_outcome_id", "l_outcome"),
}

NEW_COURSE = """(select course_id, (select max(course_id) from @courses) + row_number() over (order by course_id) as new_course_id
    from @courses where year = 2024)"""


def _child(table: str) -> str:
    key, text = _CHILD[table]
    return f"""(select t.{key}, n.new_course_id, t.{text}, (select max({key}) from @{table}) + row_number() over (order by t.{key}) as new_id
               from @{table} t join {NEW_COURSE} n using (course_id))"""


NEW_PROGRAM = """(select program_id, (select max(program_id) from @programs) + row_number() over (order by program_id) as new_program_id
    from @programs where level = 'Doctoral')"""
NEW_CATEGORY = f"""(select plo_category_id, new_program_id, plo_category,
    (select max(plo_category_id) from @p_l_o_categories) + row_number() over (order by plo_category_id) as new_id
    from @p_l_o_categories join {NEW_PROGRAM} n using (program_id))"""
NEW_SCALE = f"""(select program_id, new_program_id, map_scale_id, title,
    (select max(map_scale_id) from @mapping_scales) + row_number() over (order by program_id, map_scale_id) as new_id
    from @mapping_scale_programs join {NEW_PROGRAM} n using (program_id) join @mapping_scales s using (map_scale_id)
    where s.mapping_scale_categories_id is null)"""

_DETACHED = "(select course_id, program_id from @course_programs where map_status = 2)"
_RESET = "(select program_id from @programs where level = 'Masters')"

SQL: dict[str, str] = {
    "replace_pairs": """
        select l_outcome_id, pl_outcome_id, map_scale_id from @outcome_maps b
        where not exists (select 1 from @outcome_map_ai_suggestions i
                          where i.l_outcome_id = b.l_outcome_id and i.pl_outcome_id = b.pl_outcome_id)
        union all select l_outcome_id, pl_outcome_id, map_scale_id from @outcome_map_ai_suggestions""",
    "upsert": """
        select standard_id, course_id, coalesce(i.standard_scale_id, b.standard_scale_id) as standard_scale_id
        from @standards_outcome_maps b full join @incoming_standard_maps i using (standard_id, course_id)""",
    "duplicate_courses": f"""
        select 'courses' as kind, n.new_course_id as new_id, cast(null as bigint) as parent_id, c.course_title as text
        from {NEW_COURSE} n join @courses c using (course_id)
        union all select 'assessment_methods', new_id, new_course_id, a_method from {_child('assessment_methods')} x
        union all select 'learning_activities', new_id, new_course_id, l_activity from {_child('learning_activities')} x
        union all select 'learning_outcomes', new_id, new_course_id, l_outcome from {_child('learning_outcomes')} x
        union all select 'outcome_assessments', m.new_id, c.new_id, '' from @outcome_assessments o
          join {_child('learning_outcomes')} c using (l_outcome_id) join {_child('assessment_methods')} m using (a_method_id)
        union all select 'outcome_activities', m.new_id, c.new_id, '' from @outcome_activities o
          join {_child('learning_outcomes')} c using (l_outcome_id) join {_child('learning_activities')} m using (l_activity_id)
        union all select 'course_optional_priorities', op_id, new_course_id, '' from @course_optional_priorities
          join {NEW_COURSE} n using (course_id)""",
    "duplicate_programs": f"""
        select 'programs' as kind, n.new_program_id as new_id, cast(null as bigint) as parent_id, p.program as text
        from {NEW_PROGRAM} n join @programs p using (program_id)
        union all select 'p_l_o_categories', new_id, new_program_id, plo_category from {NEW_CATEGORY} c
        union all select 'program_learning_outcomes', (select max(pl_outcome_id) from @program_learning_outcomes)
            + row_number() over (order by o.pl_outcome_id), n.new_program_id, o.pl_outcome || ' ' || coalesce(cast(c.new_id as varchar), '-')
          from @program_learning_outcomes o join {NEW_PROGRAM} n using (program_id)
          left join {NEW_CATEGORY} c on c.plo_category_id = o.plo_category_id
        union all select 'mapping_scales', new_id, cast(null as bigint), title from {NEW_SCALE} s
        union all select 'mapping_scale_programs', new_id, new_program_id, '' from {NEW_SCALE} s
        union all select 'mapping_scale_programs', map_scale_id, new_program_id, ''
          from @mapping_scale_programs join {NEW_PROGRAM} n using (program_id) join @mapping_scales s using (map_scale_id)
          where s.mapping_scale_categories_id is not null""",
    "detach_course_programs": "select course_id, program_id, course_required, map_status from @course_programs where map_status <> 2",
    "detach_outcome_maps": f"""
        select m.* from @outcome_maps m left join @learning_outcomes l using (l_outcome_id)
        left join @program_learning_outcomes p using (pl_outcome_id)
        where not exists (select 1 from {_DETACHED} d where d.course_id = l.course_id and d.program_id = p.program_id)""".replace(
        "select m.*", "select l_outcome_id, pl_outcome_id, map_scale_id"),
    "reset_scale_family_maps": f"""
        select * from @outcome_maps where pl_outcome_id not in
          (select pl_outcome_id from @program_learning_outcomes where program_id in {_RESET})""",
    "reset_scale_family_scales": f"""
        select k.program_id, k.map_scale_id from @mapping_scale_programs k join @mapping_scales s using (map_scale_id)
        where k.program_id not in {_RESET} or s.mapping_scale_categories_id is null
        union select program_id, map_scale_id from @mapping_scales, {_RESET} r where mapping_scale_categories_id = 1""",
    "reset_scale_family_links": f"""
        select course_id, program_id, course_required, case when program_id in {_RESET} then 0 else map_status end as map_status
        from @course_programs""",
    "backfill_scale_id": """
        select l_outcome_id, pl_outcome_id, map_scale_value,
               (select min(s.map_scale_id) from @mapping_scales s where s.abbreviation = map_scale_value) as map_scale_id
        from @legacy_maps""",
    "split_legacy_program": """
        select case when program_id in (1, 2, 3) then 'category' else 'link' end as kind, course_id, program_id as value
        from @legacy_courses""",
    "match_legacy_priorities": """
        select course_id, priority_text, op_id, op_id is null as unmatched
        from @legacy_priorities left join (select optional_priority, min(op_id) as op_id from @optional_priorities
                                           group by 1) p on p.optional_priority = priority_text""",
    "course_bundles": """
        select course_id, 'outcomes' as section, cast(l_outcome_id as varchar) as item_id,
               to_json({'l_outcome': l_outcome, 'clo_shortphrase': clo_shortphrase})::varchar as item from @learning_outcomes
        union all select course_id, 'methods', cast(a_method_id as varchar), to_json({'a_method': a_method, 'weight': weight})::varchar
          from @assessment_methods
        union all select course_id, 'activities', cast(l_activity_id as varchar), to_json({'l_activity': l_activity})::varchar
          from @learning_activities
        union all select m.course_id, 'alignment', cast(o.l_outcome_id as varchar),
          to_json({'kind': 'assessment', 'item_id': a_method_id, 'item': a_method})::varchar
          from @outcome_assessments o join @assessment_methods m using (a_method_id)
        union all select m.course_id, 'alignment', cast(o.l_outcome_id as varchar),
          to_json({'kind': 'activity', 'item_id': l_activity_id, 'item': l_activity})::varchar
          from @outcome_activities o join @learning_activities m using (l_activity_id)
        union all select l.course_id, 'program_maps', cast(m.l_outcome_id as varchar),
          to_json({'program_id': p.program_id, 'pl_outcome_id': m.pl_outcome_id, 'abbreviation': s.abbreviation})::varchar
          from @outcome_maps m join @learning_outcomes l using (l_outcome_id)
          join @program_learning_outcomes p using (pl_outcome_id)
          join @course_programs cp on cp.course_id = l.course_id and cp.program_id = p.program_id
          join @mapping_scales s on s.map_scale_id = m.map_scale_id""",
}
