"""SQL for faculty membership, grants, permissions, ownership and recent work."""

FACULTIES = "(select faculty_id, faculty, campus from @faculties join @campuses using (campus_id))"

FACULTY_COURSES = f"""
    select f.faculty_id, c.course_id from @courses c join {FACULTIES} f
      on (c.campus = f.campus and c.faculty = f.faculty)
      or (exists (select 1 from @faculty_course_codes k where k.faculty_id = f.faculty_id
                  and k.course_code = c.course_code)
          and ((c.campus is null and c.faculty is null) or (c.campus = f.campus and c.faculty = f.faculty)
               or (c.campus = 'Other' and c.faculty is null and c.department is null)))"""

DEPARTMENTS = f"""(select department_id, department, f.* from @departments d join {FACULTIES} f using (faculty_id))"""


def grants(
    head: str = "true", director_wide: str = "has_access_to_all_courses_in_faculty", links: str = "@course_programs"
) -> str:
    """One branch per rule; the arguments limit the assignments taken into account."""
    holder = f"""(select user_id from @role_user join @roles using (role_id)
                  where role = 'administrator')"""
    heads = f"(select * from @department_head where {head})"
    directors = "@program_directors"
    in_department = "on x.campus = d.campus and x.faculty = d.faculty and x.department = d.department"
    return f"""
    select 'course' as entity, course_id as entity_id, user_id, 'administrator' as role,
           cast(null as bigint) as program_id, cast(null as bigint) as department_id
    from @courses, {holder} h
    union select 'program', program_id, user_id, 'administrator', null, null from @programs, {holder} h
    union select 'program', x.program_id, h.user_id, 'department head', null, d.department_id
          from {heads} h join {DEPARTMENTS} d using (department_id) join @programs x {in_department}
    union select 'course', cp.course_id, h.user_id, 'department head', x.program_id, d.department_id
          from {heads} h join {DEPARTMENTS} d using (department_id) join @programs x {in_department}
          join {links} cp on cp.program_id = x.program_id
    union select 'course', x.course_id, h.user_id, 'department head', null, d.department_id
          from {heads} h join {DEPARTMENTS} d using (department_id) join @courses x {in_department}
          where not h.has_access_to_all_courses_in_faculty
    union select 'course', x.course_id, h.user_id, 'department head', null, d.department_id
          from {heads} h join {DEPARTMENTS} d using (department_id)
          join ({FACULTY_COURSES}) x on x.faculty_id = d.faculty_id
          where h.has_access_to_all_courses_in_faculty
    union select 'program', program_id, user_id, 'program director', program_id, null from {directors} h
    union select 'course', cp.course_id, h.user_id, 'program director', h.program_id, null
          from {directors} h join {links} cp on cp.program_id = h.program_id
    union select 'course', x.course_id, h.user_id, 'program director', h.program_id, null
          from {directors} h join @programs p on p.program_id = h.program_id
          join {FACULTIES} f on f.faculty = p.faculty and f.campus = p.campus
          join ({FACULTY_COURSES}) x on x.faculty_id = f.faculty_id
          where {director_wide}"""


DIRECT = """select 'course' as entity, course_id as entity_id, user_id, permission from @course_users
            union all select 'program', program_id, user_id, permission from @program_users"""

VISIBLE = f"""select entity, user_id, entity_id from ({grants()}) g
              union select entity, user_id, entity_id from ({DIRECT}) d"""


def _age(seconds: str) -> str:
    units = [(31536000, "year"), (2592000, "month"), (604800, "week"), (86400, "day"), (3600, "hour"),
             (60, "min"), (1, "second")]
    cases = " ".join(
        f"when {seconds} // {n} = 1 then '1 {u} ago' when {seconds} // {n} <> 0 then cast({seconds} // {n} as varchar) || ' {u}s ago'"
        for n, u in units)
    return f"case {cases} else case when {seconds} is null then null else '0 seconds ago' end end"


SQL: dict[str, str] = {
    "faculty_courses": FACULTY_COURSES,
    "course_faculty": f"""
        select c.course_id, case when c.campus is not null and c.faculty is not null then f.faculty_id
               else k.faculty_id end as faculty_id
        from @courses c left join {FACULTIES} f on f.campus = c.campus and f.faculty = c.faculty
        left join @faculty_course_codes k on k.course_code = c.course_code""",
    "visible_entities": VISIBLE,
    "effective_permission": f"""
        select coalesce(g.entity, d.entity) as entity, coalesce(g.entity_id, d.entity_id) as entity_id,
               coalesce(g.user_id, d.user_id) as user_id,
               case when g.user_id is not null then 1 else coalesce(d.permission, 0) end as permission
        from (select distinct entity, entity_id, user_id from ({grants()}) x) g
        full join ({DIRECT}) d on d.entity = g.entity and d.entity_id = g.entity_id and d.user_id = g.user_id""",
    "expand_grants": grants(),
    "stale_grants": f"""select * from ({grants()}) a except
        select * from ({grants(head="not has_access_to_all_courses_in_faculty", director_wide="false")}) b""",
    "grants_by_support": "select *, count(*) as support from (" + grants(
        head="user_id % 3 <> 0", links="(select * from @course_programs where course_id % 10 <> 0)"
    ).replace("union select", "union all select") + ") g group by all",
    "course_owners": """
        select course_id, user_id, cast(case when row_number() over (partition by course_id
               order by created_at nulls last, user_id) = 1 then 1 else 2 end as bigint) as permission
        from @course_users""",
    "recent_entities": f"""
        select entity, user_id, position, entity_id, title, {_age("s")} as age
        from (select *, row_number() over (partition by entity, user_id order by updated_at desc nulls last, entity_id) as position,
                     epoch(timestamp '2026-01-01 00:00:00')::bigint - floor(epoch(updated_at))::bigint as s
              from (select v.entity, v.user_id, v.entity_id, c.course_title as title, c.updated_at
                    from ({VISIBLE}) v join @courses c on c.course_id = v.entity_id where v.entity = 'course'
                    union all
                    select v.entity, v.user_id, v.entity_id, p.program, p.updated_at
                    from ({VISIBLE}) v join @programs p on p.program_id = v.entity_id where v.entity = 'program'
                    union all select 'syllabus', user_id, syllabus_id, title, updated_at from @syllabi) e) z
        where position <= 5""",
}
