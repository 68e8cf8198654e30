"""Domain tables derived from the star-schema test tables.

Every view covers its source tables whole, so the work of a query grows with them:

====================  =======================================================
programs              one per five parts; organisation from nation and region
courses               customers
course_programs       order links, three possible programs per course
learning_outcomes     orders (CLO)
program outcomes      parts (PLO)
outcome_maps          line items
users                 suppliers
mapping_requests      events
labelled_pairs        labels
corpus_lines          documents with syllabus lines put in front
====================  =======================================================

The texts are plain SQL both Spark and the checking engine read. ``@name`` is a source table or another
view, ``@div`` integer division, ``@n_programs`` the number of programs.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from mapwise.plans.session import start_from, stored_bytes, tune

SOURCE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

N_PROGRAMS = "(select max(p_partkey) @div 5 + 1 from @part)"

VIEWS: dict[str, str] = {
    "order_links": """
        select o_orderkey, o_custkey as course_id, (o_custkey + o_orderkey % 3) % @n_programs as program_id,
               o_orderdate
        from @orders""",
    "map_lines": """
        select l.l_orderkey, l.l_partkey, l.l_suppkey, cast(l.l_linenumber as bigint) as l_linenumber,
               l.l_quantity, l.l_discount, o.o_custkey as course_id,
               (o.o_custkey + l.l_linenumber % 3) % @n_programs as program_id
        from @lineitem l join @orders o on o.o_orderkey = l.l_orderkey""",
    "programs": """
        select x.program_id, 'Program ' || cast(x.program_id as string) as program, r.r_name as faculty,
               case when r.r_regionkey % 2 = 0 then 'O' else 'V' end as campus,
               'Dept ' || cast(n.n_nationkey % 7 as string) as department,
               case x.program_id % 4 when 0 then 'Bachelors' when 1 then 'Masters'
                    when 2 then 'Doctoral' else 'Other' end as level,
               d.updated_at
        from (select distinct p_partkey @div 5 as program_id from @part) x
        join @nation n on n.n_nationkey = x.program_id % 25
        join @region r on r.r_regionkey = n.n_regionkey
        left join (select program_id, max(o_orderdate) as updated_at from @order_links group by program_id) d
          on d.program_id = x.program_id""",
    "courses": """
        select c.c_custkey as course_id, upper(substr(c.c_mktsegment, 1, 4)) as course_code,
               case when c.c_custkey % 29 = 3 then null
                    else cast(100 + (c.c_custkey * 37) % 650 as string) end as course_num,
               2020 + c.c_custkey % 5 as year,
               case c.c_custkey % 4 when 0 then 'W1' when 1 then 'W2' when 2 then 'S1' else 'S2' end as semester,
               c.c_name as course_title, cast(c.c_nationkey % 4 as bigint) as standard_category_id,
               case when c.c_custkey % 11 = 0 then null when c.c_custkey % 13 = 0 then 'Other'
                    when r.r_regionkey % 2 = 0 then 'O' else 'V' end as campus,
               case when c.c_custkey % 11 = 0 or c.c_custkey % 13 = 0 then null else r.r_name end as faculty,
               case when c.c_custkey % 11 = 0 or c.c_custkey % 13 = 0 then null
                    else 'Dept ' || cast(n.n_nationkey % 7 as string) end as department,
               d.updated_at
        from @customer c
        join @nation n on n.n_nationkey = c.c_nationkey
        join @region r on r.r_regionkey = n.n_regionkey
        left join (select o_custkey, max(o_orderdate) as updated_at from @orders group by o_custkey) d
          on d.o_custkey = c.c_custkey""",
    "course_programs": """
        select distinct course_id, program_id, cast((course_id + program_id) % 2 as bigint) as course_required,
               cast(course_id % 3 as bigint) as map_status
        from @order_links""",
    "learning_outcomes": """
        select o_orderkey as l_outcome_id, o_custkey as course_id,
               'Outcome ' || cast(o_orderkey as string) || ' ' || o_orderpriority as l_outcome,
               case when o_orderkey % 5 = 0 then null
                    else 'CLO ' || cast(o_orderkey as string) end as clo_shortphrase
        from @orders""",
    "program_learning_outcomes": """
        select p_partkey as pl_outcome_id, p_name as pl_outcome,
               case when p_partkey % 6 = 0 then null else p_brand end as plo_shortphrase,
               p_partkey @div 5 as program_id,
               case when p_size % 4 = 0 then null
                    else (p_partkey @div 5) * 10 + p_size % 3 end as plo_category_id
        from @part""",
    "p_l_o_categories": """
        select distinct plo_category_id, program_id, 'Cat ' || cast(plo_category_id as string) as plo_category
        from @program_learning_outcomes where plo_category_id is not null""",
    "mapping_scales": """
        select cast(id as bigint) as map_scale_id, title, abbreviation, colour,
               cast(cat as bigint) as mapping_scale_categories_id
        from (values (0, 'Not Applicable', 'N/A', '#ffffff', 0),
                     (1, 'Introduced', 'I', '#80bdff', 1), (2, 'Developing', 'D', '#1aa7ff', 1),
                     (3, 'Advanced', 'A', '#0065bd', 1),
                     (4, 'Principal', 'P', '#9be1e1', 2), (5, 'Secondary', 'S', '#75aeb7', 2),
                     (6, 'Major', 'Ma', '#34789d', 2), (7, 'Minor', 'Mi', '#124778', 2),
                     (8, 'Yes', 'Y', '#ffffff', 3),
                     (9, 'Foundational', 'F', '#9bc2c1', 4), (10, 'Extended', 'E', '#306463', 4),
                     (11, 'Exposure', 'X', '#aabbcc', null), (12, 'Zenith', 'Z', null, null))
             t(id, title, abbreviation, colour, cat)""",
    "mapping_scale_programs": """
        select p.program_id, s.map_scale_id
        from @programs p join @mapping_scales s
          on coalesce(s.mapping_scale_categories_id, 5) = p.program_id % 5 + 1 and s.map_scale_id <> 0""",
    "mapped_scales": """
        select l_orderkey as l_outcome_id, program_id * 5 + l_partkey % 5 as pl_outcome_id, l_linenumber,
               case when l_linenumber = 4 then cast(0 as bigint)
                    when program_id % 5 = 0 then 1 + l_linenumber % 3
                    when program_id % 5 = 1 then 4 + l_linenumber % 4
                    when program_id % 5 = 2 then cast(8 as bigint)
                    when program_id % 5 = 3 then 9 + l_linenumber % 2
                    else 11 + l_linenumber % 2 end as map_scale_id,
               case when program_id % 5 = 0 then 1 + (l_linenumber + 1) % 3
                    when program_id % 5 = 1 then 4 + (l_linenumber + 1) % 4
                    when program_id % 5 = 2 then cast(8 as bigint)
                    when program_id % 5 = 3 then 9 + (l_linenumber + 1) % 2
                    else 11 + (l_linenumber + 1) % 2 end as shifted_scale_id
        from @map_lines""",
    "outcome_maps": "select distinct l_outcome_id, pl_outcome_id, map_scale_id from @mapped_scales",
    "outcome_map_ai_suggestions": """
        select distinct l_outcome_id, pl_outcome_id, shifted_scale_id as map_scale_id
        from @mapped_scales where l_linenumber >= 5""",
    "assessment_methods": """
        select l_orderkey * 10 + l_linenumber as a_method_id, course_id,
               case min(l_partkey) % 6 when 0 then 'final' when 1 then 'final Exam' when 2 then 'midterm'
                    when 3 then 'lab Report' when 4 then 'Quiz' else 'Essay' end as a_method,
               round(min(l_discount) * 100) + 5 as weight
        from @map_lines where l_linenumber <= 2 group by l_orderkey, l_linenumber, course_id""",
    "learning_activities": """
        select l_orderkey * 10 + 3 as l_activity_id, course_id,
               case min(l_suppkey) % 5 when 0 then 'lecture' when 1 then 'group work' when 2 then 'Lab'
                    when 3 then 'field trip' else 'seminar' end as l_activity
        from @map_lines where l_linenumber = 3 group by l_orderkey, course_id""",
    "outcome_assessments": """
        select distinct l_orderkey as l_outcome_id, l_orderkey * 10 + l_linenumber as a_method_id
        from @map_lines where l_linenumber <= 2 and l_quantity > 10""",
    "outcome_activities": """
        select distinct l_orderkey as l_outcome_id, l_orderkey * 10 + 3 as l_activity_id
        from @map_lines where l_linenumber = 3 and l_quantity <= 40""",
    "standards": """
        select cast(n_nationkey as bigint) as standard_id, cast(n_nationkey % 4 as bigint) as standard_category_id,
               n_name as s_shortphrase, 'Standard ' || n_name as s_outcome
        from @nation""",
    "standard_scales": """
        select cast(id as bigint) as standard_scale_id, title, abbreviation, colour,
               cast(cat as bigint) as scale_category_id
        from (values (0, 'Not Applicable', 'N/A', '#ffffff', 0), (1, 'Introduced', 'I', '#80bdff', 1),
                     (2, 'Developing', 'D', '#1aa7ff', 1), (3, 'Advanced', 'A', '#0065bd', 1))
             t(id, title, abbreviation, colour, cat)""",
    "standards_outcome_maps": """
        select s.standard_id, c.course_id, (c.course_id + s.standard_id) % 4 as standard_scale_id
        from @courses c join @standards s on s.standard_category_id = c.standard_category_id
        where (c.course_id + s.standard_id) % 5 <> 0 and c.course_id % 7 <> 0""",
    "optional_priorities": """
        select cast(n_nationkey as bigint) as op_id, 'Priority ' || n_name as optional_priority,
               cast(n_regionkey as bigint) as subcat_id
        from @nation""",
    "optional_priority_subcategories": """
        select cast(r_regionkey as bigint) as subcat_id, r_name as subcat_name from @region""",
    "course_optional_priorities": """
        select distinct cast(s.s_nationkey as bigint) as op_id, m.course_id
        from @map_lines m join @supplier s on s.s_suppkey = m.l_suppkey""",
    "course_description": """
        select course_id, case when course_id % 6 = 0 then '' else 'About ' || course_title end as description
        from @courses where course_id % 3 <> 1""",
    "course_topics": """
        select l_outcome_id as topic_id, course_id, 'Topic ' || l_outcome as topic
        from @learning_outcomes where course_id % 4 <> 2""",
    "course_materials": """
        select l_outcome_id as material_id, course_id, 'Reading ' || l_outcome as name
        from @learning_outcomes where course_id % 5 <> 4""",
    "campuses": """
        select cast(id as bigint) as campus_id, campus from (values (0, 'O'), (1, 'V')) t(id, campus)""",
    "faculties": """
        select cast(r_regionkey as bigint) as faculty_id, r_name as faculty,
               cast(r_regionkey % 2 as bigint) as campus_id
        from @region""",
    "departments": """
        select cast(n_nationkey as bigint) as department_id, cast(n_regionkey as bigint) as faculty_id,
               'Dept ' || cast(n_nationkey % 7 as string) as department
        from @nation""",
    "faculty_course_codes": """
        select upper(substr(c_mktsegment, 1, 4)) as course_code, min(c_custkey) % 5 as faculty_id
        from @customer group by upper(substr(c_mktsegment, 1, 4))""",
    "users": "select s_suppkey as user_id, s_name as name from @supplier",
    "roles": """
        select cast(id as bigint) as role_id, role
        from (values (1, 'administrator'), (2, 'department head'), (3, 'program director'), (4, 'user')) t(id, role)""",
    "role_user": """
        select s_suppkey as user_id,
               cast(case when s_suppkey < 3 then 1 when s_suppkey % 10 = 1 then 3 else 2 end as bigint) as role_id
        from @supplier where s_suppkey < 3 or s_suppkey % 10 in (1, 2)""",
    "department_head": """
        select u.user_id, cast(s.s_nationkey as bigint) as department_id,
               u.user_id % 20 < 10 as has_access_to_all_courses_in_faculty
        from @role_user u join @supplier s on s.s_suppkey = u.user_id where u.role_id = 2""",
    "program_directors": """
        select u.user_id, (u.user_id * 3) % @n_programs as program_id,
               u.user_id % 20 < 10 as has_access_to_all_courses_in_faculty
        from @role_user u where u.role_id = 3""",
    "course_users": """
        select o_orderkey % (select count(*) from @supplier) as user_id, o_custkey as course_id,
               cast(min(1 + o_orderkey % 3) as bigint) as permission,
               min(case when (o_custkey + o_orderkey) % 6 = 0 then null else o_orderdate end) as created_at
        from @orders group by o_orderkey % (select count(*) from @supplier), o_custkey""",
    "program_users": """
        select ((p_partkey @div 5) * 7 + p_partkey % 2) % (select count(*) from @supplier) as user_id,
               p_partkey @div 5 as program_id, cast(min(1 + p_size % 3) as bigint) as permission
        from @part
        group by ((p_partkey @div 5) * 7 + p_partkey % 2) % (select count(*) from @supplier), p_partkey @div 5""",
    "syllabi": """
        select event_id as syllabus_id, user_id, 'Syllabus ' || cast(event_id as string) as title,
               ts as updated_at
        from @events""",
    "mapping_requests": """
        select event_id as request_id, user_id as course_id, (user_id + event_id % 3) % @n_programs as program_id,
               case event_type when 'view' then 'PENDING' when 'click' then 'IN_PROGRESS'
                    when 'purchase' then 'AWAITING_COMPLETION' when 'error' then 'AWAITING_COMPLETION_FAILED'
                    else 'DONE' end as status,
               'store/batch_inputs/' || cast(event_id as string) || '.jsonl' as input_path,
               case when event_id % 4 = 0 then null when event_id % 4 = 1 then ''
                    else 'store/batch_outputs/' || cast(event_id as string) || '.jsonl.out' end as output_path,
               case when event_type = 'view' and event_id % 20 = 7 then null else ts end as created_at
        from @events""",
    "labelled_pairs": """
        select doc_id as id, cast(quality as bigint) as score,
               case when quality = 1 and doc_id % 2 = 1 then 'I' end as i_label,
               case when quality = 1 and (doc_id @div 2) % 2 = 1 then 'R' end as r_label,
               case when quality = 1 and (doc_id @div 4) % 2 = 1 then 'E' end as e_label
        from @labels""",
    "predictions": """
        select run.run_id, p.doc_id as id, cast(turn.position as bigint) as position,
               case (p.doc_id * (2 * run.k + 3) + turn.position) % 8
                    when 0 then '' when 1 then 'I' when 2 then 'r' when 3 then 'I, R' when 4 then 'e'
                    when 5 then 'I,e' when 6 then 'R,E, X' else 'I,R,E' end as map_labels
        from @labels p join (values (0, 'prompt-a'), (1, 'prompt-b'), (2, 'prompt-c')) run(k, run_id)
          on (p.doc_id + run.k) % 9 <> 0
        join (values (0), (1)) turn(position) on turn.position = 0 or p.doc_id % 5 = 2""",
    "answer_texts": """
        select l_outcome_id, pl_outcome_id, l_outcome_id % 7 as kind,
               'clo-' || cast(l_outcome_id as string) || '__plo-' || cast(pl_outcome_id as string) as pair_id,
               case when min(map_scale_id) = 0 then 'false' else 'true' end as mapped,
               min(map_scale_id) as map_scale_id
        from @outcome_maps group by l_outcome_id, pl_outcome_id""",
    "request_scales": """
        select k.program_id, s.map_scale_id, s.title,
               case when s.map_scale_id = 12 and k.program_id % 2 = 1 then null else s.abbreviation end as abbreviation
        from @mapping_scale_programs k join @mapping_scales s on s.map_scale_id = k.map_scale_id
        where not (k.program_id % 5 = 2 and k.program_id % 3 = 0)""",
    "list_answers": """
        select l_outcome_id, pl_outcome_id, case when kind = 3 then
                '<think>half</think>[{"mapLabels": ["I"], "explanation": "no id"}, {"id": "' || pair_id
                || '", "mapLabels": ["R"], "explanation": "kept"}]' else case kind % 3
            when 0 then '<think>' || chr(10) || 'weighing ' || pair_id || chr(10) || '</think>' || chr(10) || chr(10)
                        || '[{"id": "' || pair_id || '", "mapLabels": ["I", "R"], "explanation": "first"}, '
                        || '{"id": "' || pair_id || '-b", "mapLabels": [], "explanation": "second"}]'
            when 1 then '<think>short</think>{"id": "' || pair_id || '", "mapLabels": ["E"], "explanation": "cut off he'
            else 'no block and no answer' end end as generated_text
        from @answer_texts""",
    "incoming_standard_maps": """
        select c.course_id, s.standard_id, (c.course_id + s.standard_id + 1) % 4 as standard_scale_id
        from @courses c join @standards s on s.standard_category_id = c.standard_category_id
        where c.semester = 'W1'""",
    "legacy_maps": """
        select a.l_outcome_id, a.pl_outcome_id,
               case when a.kind = 6 then 'Q' else s.abbreviation end as map_scale_value,
               cast(null as bigint) as map_scale_id
        from @answer_texts a join @mapping_scales s on s.map_scale_id = a.map_scale_id""",
    "legacy_courses": "select course_id, program_id from @course_programs",
    "legacy_priorities": """
        select c.course_id, case when o.subcat_id = 4 then o.optional_priority || ' (old)'
                                 else o.optional_priority end as priority_text
        from @course_optional_priorities c join @optional_priorities o on o.op_id = c.op_id""",
    "model_result_lines": """
        select l_outcome_id, pl_outcome_id, case kind
            when 0 then '{"generated_text": "' || body || '"}'
            when 1 then '[{"generated_text": "' || replace(replace(body, '[', ''), ']', '') || '"}]'
            when 2 then '{"generated_text": "<think>weighing it</think> ' || body || '"}'
            when 3 then '{"generated_text": "ID: ' || pair_id || bn || 'CLO: Outcome ' || cast(l_outcome_id as string)
                        || bn || 'Explanation: because: yes"}'
            when 4 then '{"generated_text": "{' || q || 'CLO' || q || ': ' || q || 'no id' || q || '}"}'
            when 5 then '{"generated_text": "' || pair_id
            else case when pl_outcome_id % 2 = 0 then chr(9) || ' ' else '{"other": 1}' end end as line
        from (select l_outcome_id, pl_outcome_id, kind, pair_id, chr(92) || '"' as q, chr(92) || 'n' as bn,
                     '{' || chr(92) || '"id' || chr(92) || '": ' || chr(92) || '"' || pair_id || chr(92) || '", '
                     || chr(92) || '"CLO' || chr(92) || '": ' || chr(92) || '"Outcome '
                     || cast(l_outcome_id as string) || chr(92) || '", ' || chr(92) || '"is_mapped' || chr(92)
                     || '": ' || mapped || ', ' || chr(92) || '"explanation' || chr(92) || '": ' || chr(92)
                     || '"close match' || chr(92) || '", ' || chr(92) || '"mapLabels' || chr(92) || '": ['
                     || chr(92) || '"L' || cast(map_scale_id as string) || chr(92) || '"]}' as body
              from @answer_texts) t""",
}


def _names(text: str) -> list[str]:
    return [n for n in re.findall(r"@(\w+)", text) if n not in ("div", "n_programs")]


def check_engine_sql(body: str) -> str:
    """The query as one statement for the checking engine: every view it needs becomes a WITH entry."""
    ordered: list[str] = []
    extra = _check_engine_views()

    def visit(text: str) -> None:
        text = text.replace("@n_programs", N_PROGRAMS)
        for name in _names(text):
            if name in SOURCE_TABLES or name in ordered:
                continue
            visit(extra.get(name) or VIEWS[name])
            ordered.append(name)

    visit(body)
    parts = [f"{n} as ({_render(extra.get(n) or VIEWS[n], '//', lambda x: x)})" for n in ordered]
    main = _render(body, "//", lambda x: x)
    if not parts:
        return main
    stripped = main.lstrip()
    if stripped.lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + stripped[5:]
    return "with " + ", ".join(parts) + " " + main


def _check_engine_views() -> dict[str, str]:
    from mapwise.sources.corpus import CHECK_ENGINE_CORPUS

    return {"corpus_lines": CHECK_ENGINE_CORPUS}


def _render(text: str, div: str, view) -> str:
    text = text.replace("@n_programs", N_PROGRAMS).replace("@div", div)
    return re.sub(r"@(\w+)", lambda m: view(m.group(1)), text)


class Tables:
    """Domain tables of one data folder, built on first use: ``Tables(spark, dir)["courses"]``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        self._prefix = "mw_" + hashlib.md5(self.folder.encode()).hexdigest()[:8] + "_"
        self._frames: dict[str, DataFrame] = {}
        self._bytes = 0

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def _build(self, name: str) -> DataFrame:
        if name in SOURCE_TABLES:
            path = f"{self.folder}/{name}.parquet"
            self._bytes += stored_bytes(self.spark, path)
            start_from(self.spark, self._bytes)
            return self.spark.read.parquet(path)
        if name == "corpus_lines":
            from mapwise.sources.corpus import corpus_lines

            return corpus_lines(self["documents"])
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        def view(name: str) -> str:
            self[name].createOrReplaceTempView(self._prefix + name)
            return self._prefix + name

        return self.spark.sql(_render(text, "div", view))
