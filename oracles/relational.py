"""SQL for the program, map, coverage and report queries."""

RESOLVED = """
    select cp.program_id, cp.course_id, m.l_outcome_id, m.pl_outcome_id, m.map_scale_id, s.abbreviation
    from @outcome_maps m join @learning_outcomes c using (l_outcome_id)
    join @program_learning_outcomes p using (pl_outcome_id)
    join @course_programs cp on cp.course_id = c.course_id and cp.program_id = p.program_id
    join @mapping_scales s on s.map_scale_id = m.map_scale_id"""

_LINK = "@course_programs cp join @courses c on c.course_id = cp.course_id"
SCOPES = " union all ".join(
    f"select cp.program_id, cp.course_id, '{scope}' as scope from {_LINK} where {test}"
    for scope, test in [
        ("all", "true"), ("required", "course_required = 1"), ("non_required", "course_required = 0"),
        ("year1", "left(course_num, 1) = '1'"), ("year2", "left(course_num, 1) = '2'"),
        ("year3", "left(course_num, 1) = '3'"), ("year4", "left(course_num, 1) = '4'"),
        ("graduate", "left(course_num, 1) in ('5', '6')"),
    ]
)

PLO_LABELS = """
    select p.program_id, p.pl_outcome_id, p.plo_category_id, k.plo_category,
           row_number() over w as position,
           case when length(trim(p.plo_shortphrase)) > 0 then p.plo_shortphrase
                else 'PLO #' || cast(row_number() over w as varchar) end as label
    from @program_learning_outcomes p left join @p_l_o_categories k using (plo_category_id)
    window w as (partition by p.program_id order by p.plo_category_id nulls last, p.pl_outcome_id)"""

CELL_COUNTS = f"""
    select program_id, pl_outcome_id, course_id, map_scale_id, abbreviation, count(*) as n
    from ({RESOLVED}) r group by all"""

MODAL = f"""
    select program_id, pl_outcome_id, course_id,
           string_agg(abbreviation, ' / ' order by map_scale_id) as label, count(*) > 1 as is_tie,
           case when count(*) > 1 or min(colour) is null then '#ffffff' else min(colour) end as colour,
           max(n) as n
    from (select x.*, s.colour, max(n) over (partition by program_id, pl_outcome_id, course_id) as top
          from ({CELL_COUNTS}) x join @mapping_scales s using (map_scale_id)) y
    where n = top group by program_id, pl_outcome_id, course_id"""

# Pairs replaced by suggestions, without those of courses that left and of programs that were reset.
_FED = """
    select a.* from (
        select l_outcome_id, pl_outcome_id, map_scale_id from @outcome_maps b where not exists (
            select 1 from @outcome_map_ai_suggestions i where i.l_outcome_id = b.l_outcome_id and i.pl_outcome_id = b.pl_outcome_id)
        union all select distinct l_outcome_id, pl_outcome_id, map_scale_id from @outcome_map_ai_suggestions) a
    left join @learning_outcomes l using (l_outcome_id) left join @program_learning_outcomes p using (pl_outcome_id)
    where not exists (select 1 from @course_programs d
                      where d.map_status = 2 and d.course_id = l.course_id and d.program_id = p.program_id)
      and not exists (select 1 from @programs g where g.level = 'Masters' and g.program_id = p.program_id)"""

DOMINANT = f"""
    select program_id, pl_outcome_id, course_id, abbreviation as label, map_scale_id
    from (select x.*, row_number() over (partition by x.program_id, pl_outcome_id, course_id
              order by case when x.map_scale_id = 0 then -1
                            when f.family is null then x.map_scale_id
                            when f.family = 1 then coalesce(list_position(['I','D','A'], x.abbreviation), 0)
                            when f.family = 2 then coalesce(list_position(['Mi','Ma','S','P'], x.abbreviation), 0)
                            when f.family = 3 then coalesce(list_position(['Y'], x.abbreviation), 0)
                            when f.family = 4 then coalesce(list_position(['F','E'], x.abbreviation), 0)
                            else 0 end desc, x.map_scale_id desc) as rn
          from ({CELL_COUNTS}) x
          left join (select g.program_id, s.mapping_scale_categories_id as family
                     from (select program_id, min(map_scale_id) as low from ({RESOLVED}) r
                           where map_scale_id <> 0 group by program_id) g
                     join @mapping_scales s on s.map_scale_id = g.low) f on f.program_id = x.program_id) y
    where rn = 1"""

CELL_TEXT = f"""
    select distinct r.program_id, r.pl_outcome_id, r.course_id, r.l_outcome_id, l.l_outcome
    from ({RESOLVED}) r join @learning_outcomes l on l.l_outcome_id = r.l_outcome_id where r.map_scale_id <> 0"""

PAIR_LABELS = """
    select l_outcome_id, pl_outcome_id, string_agg(abbreviation, ' / ' order by map_scale_id) as label
    from (select distinct l_outcome_id, pl_outcome_id, map_scale_id from @outcome_maps) m
    join @mapping_scales s using (map_scale_id) group by l_outcome_id, pl_outcome_id"""


def _caps(col: str) -> str:
    return (f"array_to_string(list_transform(string_split({col}, ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def _frequency(table: str, title: str) -> str:
    return f"""select s.program_id, s.scope, {_caps(title)} as {title}, count(*) as n
               from ({SCOPES}) s join {table} i on i.course_id = s.course_id group by all"""


UNALIGNED = """
    select course_id, l_outcome_id, l_outcome_id in (select l_outcome_id from @outcome_assessments) as has_assessment,
           l_outcome_id in (select l_outcome_id from @outcome_activities) as has_activity
    from @learning_outcomes
    where not (l_outcome_id in (select l_outcome_id from @outcome_assessments)
               and l_outcome_id in (select l_outcome_id from @outcome_activities))"""

LEVEL = """case when level in ('Undergraduate', 'Bachelors') then 1 when level = 'Masters' then 2
           when level = 'Doctoral' then 3 else 0 end"""

COVERAGE_COURSES = f"""
    select p.program_id, s.standard_id, coalesce(m.standard_scale_id, 0) as standard_scale_id, c.course_id
    from @course_programs cp join @programs p using (program_id) join @courses c on c.course_id = cp.course_id
    join @standards s on s.standard_category_id = c.standard_category_id
    left join @standards_outcome_maps m on m.course_id = c.course_id and m.standard_id = s.standard_id
    where c.standard_category_id = {LEVEL}
      and c.course_id in (select course_id from @standards_outcome_maps)"""

MAPPED_FLAG = f"""
    select cp.program_id, cp.course_id,
           case when count(l.l_outcome_id) > 0 and count(l.l_outcome_id) = count(r.l_outcome_id) then 'Yes'
                else 'No' end as mapped
    from @course_programs cp left join @learning_outcomes l on l.course_id = cp.course_id
    left join (select distinct program_id, l_outcome_id from ({RESOLVED}) z) r
      on r.program_id = cp.program_id and r.l_outcome_id = l.l_outcome_id
    group by cp.program_id, cp.course_id"""

PROGRESS = f"""
    select course_id, d1 + d2 + d3 + d4 + d5 + d6 + d7 + d8 + d9 as steps_done, total as steps_total,
           cast(round((d1 + d2 + d3 + d4 + d5 + d6 + d7 + d8 + d9) / total * 100) as bigint) as percent,
           concat_ws('; ', case when d1 = 0 then 'Course Description (Step 1)' end,
             case when d2 = 0 then 'Course Topics (Step 2)' end, case when d3 = 0 then 'Course Materials (Step 3)' end,
             case when d4 = 0 then 'Course Learning Outcomes (Step 4)' end,
             case when d5 = 0 then 'Student Assessment Methods (Step 5)' end,
             case when d6 = 0 then 'Teaching and Learning Activities (Step 6)' end,
             case when d7 = 0 then 'Assessment Methods - Course Alignment (Step 7)' end,
             case when d7 = 0 then 'Learning Activities - Course Alignment (Step 7)' end,
             case when d7 = 1 then 'Course Alignment (Step 7)' end,
             case when d8 = 0 then 'Program Outcome Mapping (Step 8)' end,
             case when d9 = 0 and total = 10 then 'Standards (Step 9)' end) as open_steps
    from (select c.course_id,
        cast(coalesce((select bool_or(length(description) > 0) from @course_description x where x.course_id = c.course_id), false) as bigint) as d1,
        cast(c.course_id in (select course_id from @course_topics) as bigint) as d2,
        cast(c.course_id in (select course_id from @course_materials) as bigint) as d3,
        cast(c.course_id in (select course_id from @learning_outcomes) as bigint) as d4,
        cast(c.course_id in (select course_id from @assessment_methods) as bigint) as d5,
        cast(c.course_id in (select course_id from @learning_activities) as bigint) as d6,
        cast(case when c.course_id not in (select m.course_id from @assessment_methods m join @outcome_assessments a using (a_method_id))
              and c.course_id not in (select m.course_id from @learning_activities m join @outcome_activities a using (l_activity_id)) then 0
             when c.course_id in (select course_id from ({UNALIGNED}) u) then 1 else 2 end as bigint) as d7,
        cast(coalesce(n_maps, 0) >= case when need = 1 then 1 else need - 1 end as bigint) as d8,
        cast(case when c.standard_category_id <> 0 and coalesce(n_standard_maps, 0)
              = (select count(*) from @standards s where s.standard_category_id = c.standard_category_id) then 1 else 0 end as bigint) as d9,
        cast(case when c.standard_category_id = 0 then 9 else 10 end as bigint) as total
      from @courses c
      left join (select course_id, count(*) as n_maps from @outcome_maps join @learning_outcomes using (l_outcome_id)
                 join @program_learning_outcomes using (pl_outcome_id) group by course_id) m on m.course_id = c.course_id
      left join (select course_id, count(*) as n_standard_maps from @standards_outcome_maps group by course_id) sm
        on sm.course_id = c.course_id
      join (select c.course_id, case when coalesce(n_programs, 0) <= 1 then 1 else 0 end
                   + coalesce(n_plos, 0) * coalesce(n_clos, 0) as need
            from @courses c
            left join (select course_id, count(*) as n_programs, sum(n) as n_plos from @course_programs
                       join (select program_id, count(*) as n from @program_learning_outcomes group by program_id) k
                       using (program_id) group by course_id) a on a.course_id = c.course_id
            left join (select course_id, count(*) as n_clos from @learning_outcomes group by course_id) b
              on b.course_id = c.course_id) e on e.course_id = c.course_id) z"""


def _grid(cells: str, extra: str = "") -> str:
    return f"""select cp.program_id, cp.course_id, l.pl_outcome_id, l.plo_category, l.position,
                      l.label as plo_label, {extra} coalesce(x.value, '') as value
               from @course_programs cp join ({PLO_LABELS}) l on l.program_id = cp.program_id
               left join ({cells}) x on x.program_id = cp.program_id and x.pl_outcome_id = l.pl_outcome_id
                 and x.course_id = cp.course_id"""


def _presence(titles: str) -> str:
    return f"""with h as (select distinct course_id, title from ({titles}) q),
                    tt as (select distinct cp.program_id, h.title from @course_programs cp join h using (course_id))
               select cp.program_id, cp.course_id, tt.title, case when h.title is null then '' else '1' end as value
               from @course_programs cp join tt on tt.program_id = cp.program_id
               left join h on h.course_id = cp.course_id and h.title = tt.title"""


def _alignment_grid(items: str, key: str, name: str, links: str) -> str:
    return f"""select c.course_id, c.l_outcome_id, i.{key} as item_id, i.{name} as item,
                      case when k.l_outcome_id is null then '' else '1' end as value
               from @learning_outcomes c join {items} i on i.course_id = c.course_id
               left join {links} k on k.l_outcome_id = c.l_outcome_id and k.{key} = i.{key}"""


_PLO_CATEGORY = """(select p.*, coalesce(k.plo_category, 'Uncategorized') as plo_category
                    from @program_learning_outcomes p left join @p_l_o_categories k using (plo_category_id))"""

SQL: dict[str, str] = {
    "load_tables": " union all ".join(
        f"select '{n}' as table_name, count(*) as n_rows from @{n}"
        for n in ("programs", "courses", "course_programs", "learning_outcomes", "program_learning_outcomes",
                  "outcome_maps", "assessment_methods", "course_users", "mapping_requests")),
    "with_scopes": SCOPES,
    "courses_by_level": f"""
        select program_id, case when left(course_num, 1) between '1' and '6' then left(course_num, 1) || '00'
               else 'Other' end as level_bucket, count(*) as n_courses
        from {_LINK} group by all""",
    "plo_labels": PLO_LABELS,
    "program_courses": """
        select program_id, program, course_id, course_code, course_num, course_title, course_required
        from @course_programs join @programs using (program_id)
        join (select course_id, course_code, course_num, course_title from @courses) c using (course_id)""",
    "resolved_maps": RESOLVED,
    "resolved_maps_one": f"""
        select program_id, course_id, l_outcome_id, pl_outcome_id, min(map_scale_id) as map_scale_id,
               arg_min(abbreviation, map_scale_id) as abbreviation
        from ({RESOLVED}) r group by program_id, course_id, l_outcome_id, pl_outcome_id""",
    "courses_not_in_program": """
        select cu.course_id, pu.program_id, cu.user_id
        from @course_users cu join @program_users pu on pu.user_id = cu.user_id
        where not exists (select 1 from @course_programs cp
                          where cp.course_id = cu.course_id and cp.program_id = pu.program_id)""",
    "unaligned_clos": UNALIGNED,
    "alignment": """
        select course_id, l_outcome_id, l_outcome, 'assessment' as kind, a_method_id as item_id, a_method as item
        from @learning_outcomes join @outcome_assessments using (l_outcome_id)
        join (select a_method_id, a_method from @assessment_methods) m using (a_method_id)
        union all
        select course_id, l_outcome_id, l_outcome, 'activity', l_activity_id, l_activity
        from @learning_outcomes join @outcome_activities using (l_outcome_id)
        join (select l_activity_id, l_activity from @learning_activities) m using (l_activity_id)""",
    "course_program_maps": f"""
        select r.course_id, r.program_id, r.pl_outcome_id, p.plo_shortphrase, r.l_outcome_id, l.clo_shortphrase,
               r.map_scale_id, r.abbreviation, s.title as scale_title
        from ({RESOLVED}) r join @program_learning_outcomes p on p.pl_outcome_id = r.pl_outcome_id
        join @learning_outcomes l on l.l_outcome_id = r.l_outcome_id
        join @mapping_scales s on s.map_scale_id = r.map_scale_id""",
    "course_standards": """
        select c.course_id, s.standard_id, s.s_shortphrase, m.standard_scale_id, k.abbreviation as scale
        from @courses c join @standards s using (standard_category_id)
        left join @standards_outcome_maps m on m.course_id = c.course_id and m.standard_id = s.standard_id
        left join @standard_scales k on k.standard_scale_id = m.standard_scale_id""",
    "scale_frequency": f"""
        select program_id, scope, pl_outcome_id, course_id, map_scale_id, count(*) as n
        from ({RESOLVED}) r join ({SCOPES}) s using (program_id, course_id) group by all""",
    "program_map": f"""
        select program_id, scope, pl_outcome_id, course_id, label, is_tie, colour, n
        from ({MODAL}) m join ({SCOPES}) s using (program_id, course_id)""",
    "program_map_feed": f"""
        select program_id, scope, pl_outcome_id, course_id, label, is_tie, colour, n
        from ({MODAL}) m join ({SCOPES}) s using (program_id, course_id)""".replace(
        "@course_programs", "(select * from @course_programs where map_status <> 2)").replace("@outcome_maps", f"({_FED})"),
    "cell_frequencies": f"""
        select program_id, scope, pl_outcome_id, course_id, frequencies
        from (select program_id, pl_outcome_id, course_id,
                     string_agg(abbreviation || ':' || cast(n as varchar), ', ' order by abbreviation) as frequencies
              from (select program_id, pl_outcome_id, course_id, abbreviation, sum(n) as n
                    from ({CELL_COUNTS}) a group by all) b group by all) m
        join ({SCOPES}) s using (program_id, course_id)""",
    "dominant_map": DOMINANT,
    "plo_scale_matrix": """
        select g.program_id, g.pl_outcome_id, g.map_scale_id, s.title, g.is_last,
               case when lower(s.colour) in ('#ffffff', '#fff') then '#6c757d' else s.colour end as colour,
               coalesce(m.n, 0) as n
        from (select p.program_id, p.pl_outcome_id, k.map_scale_id, false as is_last
              from @program_learning_outcomes p join @mapping_scale_programs k using (program_id)
              union all select program_id, pl_outcome_id, 0, true from @program_learning_outcomes
              where program_id in (select program_id from @programs)) g
        join @mapping_scales s using (map_scale_id)
        left join (select pl_outcome_id, map_scale_id, count(*) as n from @outcome_maps group by all) m
          on m.pl_outcome_id = g.pl_outcome_id and m.map_scale_id = g.map_scale_id""",
    "assessment_frequency": f"""
        select program_id, scope, a_method, cast(sum(n) as bigint) as n
        from (select program_id, scope, n, case when a_method = 'Final' and bool_or(a_method = 'Final Exam')
                     over (partition by program_id, scope) then 'Final Exam' else a_method end as a_method
              from ({_frequency('@assessment_methods', 'a_method')}) f) g group by all""",
    "activity_frequency": _frequency("@learning_activities", "l_activity"),
    "priority_frequency": f"""
        select s.program_id, s.scope, o.subcat_id, k.subcat_name, o.op_id, o.optional_priority,
               count(distinct s.course_id) as n_courses
        from ({SCOPES}) s join @course_optional_priorities x on x.course_id = s.course_id
        join @optional_priorities o on o.op_id = x.op_id
        left join @optional_priority_subcategories k on k.subcat_id = o.subcat_id group by all""",
    "priority_courses": f"""
        select s.program_id, s.scope, x.op_id, s.course_id, c.course_code, c.course_num
        from ({SCOPES}) s join @course_optional_priorities x on x.course_id = s.course_id
        join @courses c on c.course_id = s.course_id""",
    "standards_coverage": f"""
        select p.program_id, s.standard_id, s.s_shortphrase, k.standard_scale_id, k.title as scale,
               case when lower(k.colour) in ('#ffffff', '#fff') then '#6c757d' else k.colour end as colour,
               count(v.course_id) as n_courses
        from @programs p join @standards s on s.standard_category_id = {LEVEL}
        join @standard_scales k on k.scale_category_id = 1 or k.standard_scale_id = 0
        left join ({COVERAGE_COURSES}) v on v.program_id = p.program_id and v.standard_id = s.standard_id
          and v.standard_scale_id = k.standard_scale_id
        group by all""",
    "standards_coverage_courses": COVERAGE_COURSES,
    "mapping_completeness": f"""
        select program_id, course_id, expected, actual, expected = actual as is_complete,
               bool_or(expected <> actual) over (partition by program_id) as program_has_unmapped
        from (select cp.program_id, cp.course_id,
                     (select count(*) from @program_learning_outcomes p where p.program_id = cp.program_id)
                     * greatest((select count(*) from @learning_outcomes l where l.course_id = cp.course_id), 1) as expected,
                     (select count(distinct (r.l_outcome_id, r.pl_outcome_id)) from ({RESOLVED}) r
                      where r.program_id = cp.program_id and r.course_id = cp.course_id) as actual
              from @course_programs cp) z""",
    "course_mapped_flag": MAPPED_FLAG,
    "course_progress": PROGRESS,
    "assessment_weight_total": "select course_id, sum(weight) as total_weight from @assessment_methods group by course_id",
    "category_stats": """
        select program_id, plo_category_id, count(*) as n_plos, n_categories_used, n_uncategorised,
               n_uncategorised > 0 as has_uncategorised
        from @program_learning_outcomes
        join (select program_id, count(distinct plo_category_id) as n_categories_used,
                     count(*) filter (where plo_category_id is null) as n_uncategorised
              from @program_learning_outcomes group by program_id) t using (program_id)
        group by all""",
    "cell_outcome_text": CELL_TEXT,
    "program_grid_modal": _grid(f"select *, label as value from ({MODAL}) m"),
    "program_grid_dominant": _grid(f"select *, label as value from ({DOMINANT}) m"),
    "program_grid_text": _grid(f"select *, l_outcome as value from ({CELL_TEXT}) m", "x.l_outcome_id,"),
    "outcome_grid": f"""
        select cp.program_id, cp.course_id, c.l_outcome_id, p.pl_outcome_id, coalesce(k.label, '') as label
        from @course_programs cp join @learning_outcomes c using (course_id)
        join @program_learning_outcomes p on p.program_id = cp.program_id
        left join ({PAIR_LABELS}) k on k.l_outcome_id = c.l_outcome_id and k.pl_outcome_id = p.pl_outcome_id""",
    "course_grid": f"""
        select cp.course_id, cp.program_id, p.plo_category, p.pl_outcome_id, c.l_outcome_id,
               coalesce(k.label, '') as label
        from @course_programs cp join @learning_outcomes c using (course_id)
        join {_PLO_CATEGORY} p on p.program_id = cp.program_id
        left join ({PAIR_LABELS}) k on k.l_outcome_id = c.l_outcome_id and k.pl_outcome_id = p.pl_outcome_id""",
    "presence_grid_assessment": _presence(f"select course_id, {_caps('a_method')} as title from @assessment_methods"),
    "presence_grid_activity": _presence(f"select course_id, {_caps('l_activity')} as title from @learning_activities"),
    "presence_grid_priority": _presence(
        "select course_id, optional_priority as title from @course_optional_priorities join @optional_priorities using (op_id)"),
    "alignment_grid_assessment": _alignment_grid("@assessment_methods", "a_method_id", "a_method", "@outcome_assessments"),
    "alignment_grid_activity": _alignment_grid("@learning_activities", "l_activity_id", "l_activity", "@outcome_activities"),
    "program_listing_outcomes": f"""
        select l.program_id, coalesce(l.plo_category, 'Uncategorized') as plo_category, l.position, l.pl_outcome_id,
               l.label, p.pl_outcome
        from ({PLO_LABELS}) l join @program_learning_outcomes p on p.pl_outcome_id = l.pl_outcome_id""",
    "program_listing_scales": """
        select program_id, map_scale_id, abbreviation, title, colour
        from @mapping_scale_programs join @mapping_scales using (map_scale_id)""",
    "program_listing_info": """
        select p.program_id, p.program, p.level, p.campus, p.faculty, p.department,
               (select count(*) from @program_learning_outcomes o where o.program_id = p.program_id) as n_plos,
               (select count(*) from @course_programs o where o.program_id = p.program_id) as n_courses
        from @programs p""",
    "program_listing_courses": f"""
        select cp.program_id, cp.course_id, c.course_code, c.course_num, c.course_title,
               case when cp.course_required = 1 then 'Yes' else 'No' end as required, f.mapped
        from @course_programs cp join @courses c on c.course_id = cp.course_id
        join ({MAPPED_FLAG}) f on f.program_id = cp.program_id and f.course_id = cp.course_id""",
    "course_listing_outcomes": f"""
        select cp.course_id, cp.program_id, p.pl_outcome_id, p.pl_outcome, p.plo_category
        from @course_programs cp join {_PLO_CATEGORY} p on p.program_id = cp.program_id""",
    "course_listing_scales": """
        select cp.course_id, cp.program_id, s.map_scale_id, s.abbreviation, s.title
        from @course_programs cp join @mapping_scale_programs k on k.program_id = cp.program_id
        join @mapping_scales s on s.map_scale_id = k.map_scale_id""",
    "course_listing_standards": """
        select m.course_id, m.standard_id, s.s_shortphrase, k.title as scale
        from @standards_outcome_maps m join @standards s using (standard_id)
        join @standard_scales k using (standard_scale_id)""",
}
