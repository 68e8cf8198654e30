"""SQL for the document extraction."""

from mapwise.functions import vocabulary as v
from mapwise.functions.text import any_of
from oracles import pages
from oracles.text import among, boundary, bullet_class, heading_of, label, q, strip, title, upper, words

STRIPPED = f"""
    select doc_id, file_name, page_no, line_no, rel_top, text
    from (select *, bool_or(zone <> 'body' and seen >= floor(pages * 0.8)) over (partition by doc_id, norm) as gone
          from (select *, count(*) over (partition by doc_id, zone, norm) as seen,
                       max(page_no) over (partition by doc_id) + 1 as pages
                from (select *, case when regexp_matches(t, {q(v.PAGE_NUMBER_TEXT)}) then regexp_replace(t, '[0-9]+', '<NUM>', 'g') else t end as norm,
                             case when rel_top < 0.1 then 'top' when rel_top > 0.9 then 'bottom' else 'body' end as zone
                      from (select *, {strip('text')} as t from @corpus_lines) a) b) c) d
    where not gone"""

CODES = f"""
    select n.doc_id, coalesce(nullif(regexp_extract(course, '^([A-Za-z]+)', 1), ''), 'TEST') as code,
           coalesce(cast(nullif(regexp_extract(course, '([0-9]{{3,}})', 1), '') as bigint), 999) as number
    from (select d.doc_id, case when regexp_extract(name, {q(v.FILE_NAME_CODE)}, 2) <> ''
                   then upper(regexp_extract(name, {q(v.FILE_NAME_CODE)}, 1)) || ' ' || regexp_extract(name, {q(v.FILE_NAME_CODE)}, 2)
                   else f.found end as course
          from (select doc_id, string_split(max(file_name), '/')[-1] as name from @corpus_lines group by doc_id) d
          left join (select doc_id, found from (
                select doc_id, found, row_number() over (partition by doc_id order by count(*) desc, min(line_no * 100000 + ix)) as rn
                from (select doc_id, line_no, ix, regexp_replace(codes[ix + 1], '[A-Z]$', '') as found
                      from (select doc_id, line_no, codes, unnest(range(0, len(codes))) as ix
                            from (select doc_id, line_no, list_filter(regexp_extract_all(text, {q(v.TEXT_CODE)}, 1),
                                         lambda c: regexp_matches(c, {q(v.WHOLE_CODE)})) as codes from @corpus_lines) a) b) c
                group by doc_id, found) r where rn = 1) f on f.doc_id = d.doc_id) n"""

_WORD_EDGE = r"(?:^|[^\p{L}\p{N}_])%s(?:[^\p{L}\p{N}_]|$)"
_NAMED = " + ".join(f"cast(regexp_matches(lower(title), {q(_WORD_EDGE % w)}) as int)" for w in ("code", "section", "number"))

TITLES = f"""
    with l as (select c.*, k.code, cast(k.number as varchar) as number, k.code || ' ' || cast(k.number as varchar) as course,
                      lead(t) over (partition by c.doc_id order by line_no) as nxt
               from (select *, {strip('text')} as t from @corpus_lines) c join ({CODES}) k using (doc_id)),
    cand as (select doc_id, line_no, 0 as ix, coalesce(nullif(regexp_extract(t, {q(v.TITLE_LABEL)}, 1), ''), nxt) as title
             from l where regexp_matches(t, {q(v.TITLE_LABEL)})
             union all select doc_id, line_no, 1, substr(t, instr(t, course || ':')) from l where instr(t, course || ':') > 0
             union all select doc_id, line_no, 2, regexp_extract(t, course || '\\s*–.*') from l
                       where regexp_matches(t, course || '\\s*–')
             union all select doc_id, line_no, 3, t from l where regexp_matches(t, '^.+:\\s*' || course || '$')
             union all select doc_id, line_no, 4, t from l where regexp_matches(t, {q(v.TITLE_BEFORE_CODE)})),
    counted as (select doc_id, title, count(*) as n, min(line_no * 10 + ix) as first, {_NAMED} > 1 as is_heading
                from cand where title is not null group by doc_id, title),
    best as (select doc_id, title from (select *, max(n) over (partition by doc_id) as top,
                    row_number() over (partition by doc_id, is_heading order by n desc, first) as rn from counted) x
             where not is_heading and rn = 1 and n = top),
    firsts as (select doc_id, arg_min(t, line_no) as first_line
               from (select doc_id, page_no, line_no, {strip('text')} as t from ({STRIPPED}) b) s
               where t <> '' and not regexp_matches(t, '^[0-9]+$') and page_no = 0 group by doc_id),
    tabled as ({pages.table_titles('select * from @corpus_lines')}),
    x as (select d.doc_id, d.course, tabled.title as tabled, coalesce(f.first_line, d.course) as fallback,
                 {strip("regexp_replace(replace(replace(b.title, d.code, ''), d.number, ''), '[!-/:-@\\[-`{-~]', '', 'g')")} as bare
          from (select distinct doc_id, code, number, course from l) d left join best b using (doc_id) left join firsts f using (doc_id)
          left join tabled using (doc_id))
    select doc_id, case when tabled is not null then tabled when bare is null then fallback when lower(bare) in ('course code number', 'course code') then course
           else coalesce(nullif({strip("regexp_replace(bare, '^–', '')")}, ''), fallback) end as title from x"""


def _term_name(x: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, {q(p)}) then {q(n)}" for p, n in v.TERM_NAMES) + " else '' end"


_MONTH_MAP = "map {" + ", ".join(f"{q(k)}: {n}" for k, n in v.MONTH_NUMBER.items()) + "}"

TERMS = f"""
    with l as (select doc_id, page_no, line_no, text, string_split(file_name, '/')[-1] as name,
                      nullif(regexp_extract(text, {q(v.TERM)}, 1), '') as m from @corpus_lines),
    pg as (select doc_id, page_no, arg_min(m, line_no) as m from l where m is not null group by doc_id, page_no),
    dated as (select doc_id, arg_min(m, page_no) as m from pg where regexp_matches(m, {q(v.YEAR)}) group by doc_id),
    undated as (select doc_id, arg_max(m, page_no) as m from pg where not regexp_matches(m, {q(v.YEAR)}) group by doc_id),
    mon as (select doc_id, {_MONTH_MAP}[w] as mo, count(*) as n
            from (select doc_id, unnest(regexp_extract_all(text, {q(v.WORD)}, 0)) as w from l) z
            where w in {among(v.MONTH_NUMBER)} group by all),
    top as (select doc_id, arg_min(mo, -n * 100 + mo) as mo, max(n) as n from mon group by doc_id),
    yc as (select doc_id, y, count(*) as n, min(line_no * 100000 + ix) as first
           from (select doc_id, line_no, ys[ix + 1] as y, ix
                 from (select doc_id, line_no, ys, unnest(range(0, len(ys))) as ix
                       from (select doc_id, line_no, regexp_extract_all(text, {q(v.YEAR)}, 0) as ys from l) a) b) c group by doc_id, y),
    ty as (select doc_id, y, n from (select *, row_number() over (partition by doc_id order by n desc, first) as rn from yc) z where rn = 1),
    d as (select doc_id, nullif(regexp_extract(name, {q(v.TERM)}, 1), '') as nm, nullif(regexp_extract(name, {q(v.YEAR)}, 0), '') as ny
          from (select doc_id, max(name) as name from l group by doc_id) z),
    x as (select d.doc_id, case when regexp_matches(coalesce(d.nm, ''), {q(v.YEAR)}) then d.nm else dated.m end as explicit,
                 coalesce(undated.m, case when not regexp_matches(d.nm, {q(v.YEAR)}) then d.nm end) as half,
                 coalesce(top.mo, 1) as mo, coalesce(top.n, 0) as n_mo, coalesce(d.ny, ty.y) as y, ty.n as top_n
          from d left join dated using (doc_id) left join undated using (doc_id) left join top using (doc_id) left join ty using (doc_id)),
    z as (select x.*, case when explicit is not null then {_term_name('explicit')} when half is not null and y is not null then {_term_name('half')}
                 when mo <= 4 then 'Winter Term 2' when mo <= 6 then 'Summer Term 1' when mo <= 8 then 'Summer Term 2' else 'Winter Term 1' end as term,
                 case when explicit is not null then cast(regexp_extract(explicit, {q(v.YEAR)}, 0) as bigint)
                      when half is not null and y is not null then cast(y as bigint)
                      when mo <= 4 and n_mo > 0
                           and exists (select 1 from yc where yc.doc_id = x.doc_id and yc.y = x.y and yc.n = x.top_n)
                           and not exists (select 1 from yc where yc.doc_id = x.doc_id and cast(yc.y as bigint) = cast(x.y as bigint) + 1)
                      then cast(y as bigint) - 1 else cast(y as bigint) end as yr from x)
    select doc_id, case term when 'Winter Term 1' then 'W1' when 'Winter Term 2' then 'W2' when 'Summer Term 1' then 'S1'
           when 'Summer Term 2' then 'S2' else 'W2' end as term, coalesce(yr, 2026) as year from z"""

SQL: dict[str, str] = {
    "corpus_lines": "select doc_id, file_name, page_no, line_no, rel_top, text from @corpus_lines",
    "strip_headers": STRIPPED,
    "course_code": CODES,
    "course_title": TITLES,
    "course_term": TERMS,
}

DESCRIPTIONS = f"""
    with a as (select doc_id, line_no, {strip('text')} as t from ({STRIPPED}) s),
    b as (select *, regexp_replace(t, {q(v.BULLET)}, '') as bare, {bullet_class('t')} as cls from a),
    c as (select *, (lower(bare) in {among(v.DESCRIPTION_HEADINGS)} or replace(lower(bare), ':', '') in {among(v.DESCRIPTION_HEADINGS)}) as st,
                 case when {words('t')} between 1 and 3 then array_to_string(list_filter(regexp_extract_all(t, {q(v.WORD)}, 0),
                      lambda w: lower(w) not in {among(v.STOP_WORDS)}), ' ') end as short from b),
    d as (select *, coalesce({upper('short')}, false) as caps,
                 coalesce({upper('short')} or {title('short')} or lower(short) in {among(v.DESCRIPTION_STOPS)}, false) as headed,
                 (lower(t) in {among(v.DESCRIPTION_PARTS)} or replace(lower(t), ':', '') in {among(v.DESCRIPTION_PARTS)}
                  or regexp_matches(t, {q(v.COURSE_LINE)})) as exempt,
                 sum(cast(st as int)) over (partition by doc_id order by line_no) as sec from c),
    h as (select doc_id, sec, {upper('bare')} as own, coalesce(cls, '') as mark from d where st),
    e as (select d.*, not st and not exempt and ((mark <> '' and coalesce(cls, '') = mark) or (case when own then caps else headed end)) as stop
          from d join h using (doc_id, sec)),
    f as (select *, max(cast(stop as int)) over (partition by doc_id, sec order by line_no) as ended from e),
    g as (select doc_id, sec, line_no, t from f where not st and ended = 0),
    k as (select doc_id, sec, sum(length(t) + 2) as n from g group by doc_id, sec),
    m as (select doc_id, sec, coalesce(sum(n) over (partition by doc_id order by sec rows between unbounded preceding and 1 preceding), 0) as bef from k)
    select doc_id, replace({strip("string_agg(t, ' ' || chr(10) order by line_no)")}, chr(160), '') as description
    from g join m using (doc_id, sec) where bef <= 15 group by doc_id"""

_VERBS = r"^(?:(?:be able to|will be able to|be|students will be able to) )?(?:" + any_of(v.GOAL_VERBS) + r")(?:\s|$)"

GOALS = f"""
    with a as (select doc_id, line_no, {strip('text')} as t from ({STRIPPED}) s),
    b as (select *, case when not regexp_matches(t, '^[0-9]+/[0-9]+') then {bullet_class('t')} end as cls,
                 regexp_matches({strip("regexp_replace(lower(t), '[^\\p{L}\\p{N}_\\s]', '', 'g')")}, {q(_VERBS)}) as verb,
                 lower(regexp_replace(t, {q(v.BULLET)}, '')) in {among(v.GOAL_HEADINGS)} as st,
                 (t = '' or {upper('t')} or {title('t')}) as closing from a),
    c as (select *, lead(cls) over w as ncls, lead(verb) over w as nverb, sum(cast(st as int)) over w as sec
          from b window w as (partition by doc_id order by line_no)),
    d as (select *, first_value(cls ignore nulls) over (partition by doc_id, sec order by line_no rows between unbounded preceding and current row) as kind
          from c where sec > 0 and not st),
    e as (select *, sum(cast(case when kind is not null then coalesce(cls = kind, false) else verb end as int))
                    over (partition by doc_id, sec order by line_no) as item from d),
    f as (select *, max(cast((closing and cls is null and not verb and not coalesce(nverb or ncls = kind, false) and item >= 1)
                        or (cls is not null and cls <> kind) as int)) over (partition by doc_id, sec order by line_no) as ended from e),
    g as (select *, max(sec) over (partition by doc_id) as last_sec from f where ended = 0 and item > 0 and t <> '')
    select doc_id, cast(item as bigint) as position, regexp_replace({strip("string_agg(t, ' ' order by line_no)")}, {q(v.BULLET)}, '') as goal
    from g where sec = last_sec group by doc_id, item"""

_CONTENTS = f"bool_or(regexp_matches(lower(text), {q(any_of(v.CONTENTS_PAGES))})) over (partition by doc_id, page_no)"


def _rx(x: str, p: str, g: int = 1) -> str:
    return f"regexp_extract({x}, {q(p)}, {g})"


def _m(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


TOPICS = f"""
    with a as (select *, {strip('text')} as t, {_CONTENTS} as contents from ({STRIPPED}) s),
    b as (select *, min(line_no) filter (where {heading_of('t', v.TOPIC_HEADINGS)} and not contents) over (partition by doc_id) as opened from a),
    c as (select *, max(cast({boundary('t', v.TOPIC_STOPS, v.TOPIC_HEADINGS)} and not {_m('t', v.LONE_MARK)} as int))
                    over (partition by doc_id order by line_no) as ended from b where line_no > opened and t <> ''),
    d as (select doc_id, line_no, t, {_m('t', v.LIST_MARK)} as listed, {strip(_rx('t', v.LIST_MARK))} as marked from c
          where ended = 0 and {label('t')} not in {among(v.TOPIC_SECTION_NOISE)}),
    e as (select *, bool_or(listed) over (partition by doc_id) as any_listed, lead(t) over w as nt, lead(listed) over w as nl
          from d window w as (partition by doc_id order by line_no)),
    f as (select doc_id, line_no, case when any_listed then case when listed then case when marked <> '' then marked when not nl then nt end end
                 when {_m('t', v.BULLET)} then {strip(f"regexp_replace(t, {q(v.BULLET)}, '')")}
                 when {_m('t', v.MODULE_LINE)} then {strip(_rx('t', v.MODULE_LINE))}
                 when {_m('t', v.DATED_LINE)} then {strip(_rx('t', v.DATED_LINE))}
                 when {words('t')} between 3 and 12 and not ends_with(t, '.') then t end as topic from e)
    select doc_id, line_no, topic from f where length(topic) > 0"""
TEXT_TOPICS, TABLE_TOPICS = TOPICS, pages.table_topics(STRIPPED)
TOPICS = f"""
    with tabled as ({TABLE_TOPICS})
    select * from tabled union all
    select * from ({TEXT_TOPICS}) t where doc_id not in (select doc_id from tabled)"""

_UNMARKED = strip(f"regexp_replace({strip('topic')}, {q(v.BULLET)}, '')")
_UNSTARRED = strip(f"regexp_replace(regexp_replace({_UNMARKED}, '[–—]', '-', 'g'), '\\*+$', '')")
CLEAN_TOPICS = f"""
    with a as (select doc_id, line_no, {_UNSTARRED} as t from ({TOPICS}) x),
    b as (select *, case when instr(t, ' Workshop:') > 0 then {strip("substr(t, 1, instr(t, ' Workshop:') - 1)")} else t end as u from a),
    c as (select doc_id, min(line_no) as line_no, {strip(f"regexp_replace(u, {q(v.TOPIC_STAFF)}, '')")} as topic from b
          where u <> '' and not {_m('u', v.TOPIC_LABELS)} and not {_m('u', v.TOPIC_DEADLINES)}
            and not regexp_matches({strip("regexp_replace(lower(u), '\\s+', ' ', 'g')")}, {q(any_of(v.TOPIC_NOISE))})
          group by 1, 3)
    select doc_id, line_no, row_number() over (partition by doc_id order by line_no) as position, topic from c"""

_NOISE_WORD = r"(?:^|\s)(?:" + any_of(v.ASSESSMENT_NOISE) + r")(?:\s|$)"
_USABLE = f"""not {_m('lower(name)', _NOISE_WORD)} and name not in {among(v.LETTER_GRADES)} and length(name) >= 3 and weight <> '100'"""

ASSESSMENTS = f"""
    with a as (select doc_id, page_no, line_no, {strip('text')} as t from @corpus_lines),
    b as (select *, lag(t) over (partition by doc_id order by line_no) as above from a),
    r as (select doc_id, page_no, line_no, unnest(range(0, len(ns))) as ix, ns, ws
          from (select *, regexp_extract_all(t, {q(v.WEIGHTED)}, 1) as ns, regexp_extract_all(t, {q(v.WEIGHTED)}, 2) as ws from b) z),
    p as (select doc_id, page_no, line_no, ix, {strip('ns[ix + 1]')} as name, ws[ix + 1] as weight from r
          union all select doc_id, page_no, line_no, 1000, {strip(_rx('t', v.BRACKETED))}, {_rx('t', v.BRACKETED, 2)} from b where {_m('t', v.BRACKETED)}
          union all select doc_id, page_no, line_no, 1001, above, {_rx('t', v.WEIGHT_ALONE)} from b
            where {_m('t', v.WEIGHT_ALONE)} and regexp_matches(above, '^[A-Z]')),
    u as (select doc_id, page_no, line_no, ix, name, cast(weight as double) as weight from p where {_USABLE}),
    s as (select *, sum(weight) over w as total, count(*) over w as n from u window w as (partition by doc_id, page_no)),
    g as (select *, min(page_no) filter (where total >= 100 and n > 1) over (partition by doc_id) as accepted from s),
    items as (select doc_id, line_no, ix, name, weight from g where accepted is null or accepted = page_no),
    l as (select *, min(line_no) filter (where lower(t) in ('component', 'components')) over w as f0,
                 min(line_no) filter (where lower(t) in ('percentage', 'points/marks')) over w as f1
          from a where t <> '' window w as (partition by doc_id, page_no)),
    m as (select *, max(cast(line_no > f1 and not ({_m('lower(t)', r'^[0-9]+%(?:\s+each\s+\([0-9]+%\s+total\))?$')}
                    or (contains(lower(t), 'each') and contains(lower(t), 'total'))) as int)) over (partition by doc_id, page_no order by line_no) as broken
          from l where f0 < f1 and line_no > f0),
    nn as (select doc_id, page_no, f1, t, row_number() over (partition by doc_id, page_no order by line_no) - 1 as ix from m where line_no < f1),
    ww as (select doc_id, page_no, t, row_number() over (partition by doc_id, page_no order by line_no) - 1 as ix from m where line_no > f1 and broken = 0),
    ll as (select nn.doc_id, nn.f1 as line_no, nn.ix, nn.t as name, regexp_extract(ww.t, '([0-9]+\\.?[0-9]*)', 1) as weight
           from nn join ww using (doc_id, page_no, ix)),
    lists as (select doc_id, line_no, ix, name, cast(weight as double) as weight from ll where {_USABLE} and doc_id not in (select doc_id from items)),
    tabled as ({pages.table_weights('select * from @corpus_lines')}),
    -- The page at which the text is accepted, or at which its components stand when it has given nothing before.
    ends as (select doc_id, min(page_no) as page_no from (
               select doc_id, accepted as page_no from g where accepted is not null
               union all select c.doc_id, c.page_no from (
                 select doc_id, page_no from a group by doc_id, page_no
                 having bool_or(contains(lower(t), 'component')) and bool_or(contains(lower(t), 'percentage'))) c
                 where not exists (select 1 from u where u.doc_id = c.doc_id and u.page_no <= c.page_no)) e group by doc_id),
    first_table as (select tabled.* from tabled left join ends using (doc_id) where ends.page_no is null or tabled.page_no <= ends.page_no),
    al as (select doc_id, nth as line_no, 0 as ix, name, weight from first_table
           union all select * from items where doc_id not in (select doc_id from first_table)
           union all select * from lists where doc_id not in (select doc_id from first_table))
    select doc_id, row_number() over (partition by doc_id order by line_no, ix) as position, name, weight from al"""

_NAMED_KEYS = [k for k in v.MATERIAL_KEYWORDS if k not in v.GENERIC_KEYWORDS]

MATERIALS = f"""
    with a as (select *, {strip('text')} as t, {_CONTENTS} as contents from ({STRIPPED}) s),
    b as (select *, {label('t')} as lab, min(line_no) filter (where {heading_of('t', v.MATERIAL_HEADINGS)} and not contents) over (partition by doc_id) as opened from a),
    c as (select *, {strip(f"regexp_replace(t, {q(v.BULLET)}, '')")} as nm, {_m('t', v.BULLET)} as bul from b where line_no >= opened),
    d as (select *, case when instr(nm, ':') > 0 then {strip("substr(nm, 1, instr(nm, ':') - 1)")} end as lft,
                 case when instr(nm, ':') > 0 then {strip("substr(nm, instr(nm, ':') + 1)")} end as rgt,
                 {_m('lower(nm)', any_of(v.MATERIAL_KEYWORDS))} as kw from c),
    e as (select *, case when t = '' then 'blank' when lab in {among(v.MATERIAL_LABELS)} then 'label'
            when line_no = opened or lab in {among(v.MATERIAL_HEADINGS)} then 'heading'
            when {boundary('t', v.MATERIAL_STOPS, v.MATERIAL_HEADINGS)} then 'end'
            when lab in {among(v.MATERIAL_LINE_NOISE)} or starts_with(lab, {q(v.SKIPPED_START)}) then 'skip'
            when contains(lab, {q(v.SUGGESTED)}) then 'label'
            when starts_with(lab, 'http') or {_m('lab', any_of(v.INSTRUCTION_PHRASES))} then 'skip'
            when {_m('t', v.BIBLIOGRAPHY)} and not regexp_matches(t, '^G\\s+') and not bul then 'bibliography'
            when {_m('t', v.NUMBERED_ITEM)} then 'numbered'
            when bul and coalesce(lower(lft) in {among(v.MATERIAL_LABELS)}, false) then 'labelled'
            when bul and ({_m('nm', v.CITATION)} or {_m('nm', v.ENDS_WITH_YEAR)}) then 'cited'
            when bul then 'bullet' when {_m('t', v.CITATION)} then 'citation' when {_m('t', v.TEXTBOOK_IS)} then 'textbook'
            when lft <> '' and rgt <> '' and kw and lower(lft) in {among(v.MATERIAL_LABELS)} then 'colon label'
            when lft <> '' and rgt <> '' and kw and {_m('lower(lft)', any_of(_NAMED_KEYS))} then 'colon named'
            when kw then 'keyword' else 'other' end as kind from d),
    f as (select *, coalesce(max(cast(kind not in ('blank', 'label', 'heading', 'end', 'skip', 'other') as int))
                    over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as items from e),
    g as (select * from (select *, max(cast(kind = 'end' or (kind = 'heading' and items = 1) as int)) over (partition by doc_id order by line_no) as done from f) z where done = 0),
    h as (select *, kind in ('bibliography', 'numbered', 'cited', 'citation') as opn,
                 kind in ('textbook', 'colon label', 'colon named', 'keyword', 'other') as soft from g),
    i as (select *, last_value(case when opn then 'open' when not soft then 'closed' end ignore nulls) over w as state,
                 sum(cast(opn as int)) over w as entry,
                 last_value(case when kind = 'label' then case when lab in {among(v.MATERIAL_LABELS)} then regexp_replace(t, ':+$', '')
                   else {q(v.SUGGESTED)} end end ignore nulls) over w as under,
                 lag(kind) over w as pk, lead(kind) over w as nk, lead(t) over w as nt
          from h window w as (partition by doc_id order by line_no rows between unbounded preceding and current row)),
    j as (select *, soft and coalesce(state, 'closed') = 'open' as cont from i),
    en as (select doc_id, min(line_no) as line_no, arg_min(kind, line_no) as kind, arg_min(coalesce(under, ''), line_no) as under,
                  string_agg(case when kind = 'numbered' then {_rx('t', v.NUMBERED_ITEM)} when kind = 'cited' then nm else t end, ' ' order by line_no) as name
           from j where opn or cont group by doc_id, entry),
    al as (select doc_id, line_no, name, case when under <> '' then under when kind in ('bibliography', 'numbered') then 'Course materials' else 'Required Textbook' end as description,
                  case when under <> '' or kind in ('bibliography', 'numbered') then under else 'Required Textbook' end as infer
           from en where kind <> 'numbered' or {_m('name', v.PUBLICATION)}
           union all select doc_id, line_no, name, description, description from (
             select doc_id, line_no,
               case kind when 'labelled' then rgt when 'bullet' then nm when 'textbook' then {strip(_rx('t', v.TEXTBOOK_IS, 2))}
                    when 'colon label' then rgt when 'colon named' then lft else t end as name,
               case kind when 'labelled' then lft when 'bullet' then case when coalesce(nk = 'other', false) then nt else coalesce(under, 'resource for course') end
                    when 'textbook' then {strip(f"regexp_replace({_rx('t', v.TEXTBOOK_IS, 1)}, '(?i) is$', '')")}
                    when 'colon label' then lft when 'colon named' then rgt else coalesce(under, 'resource for course') end as description
             from j where not opn and not cont and not (kind = 'other' and coalesce(pk = 'bullet', false))
               and (kind in ('labelled', 'textbook', 'colon label', 'colon named', 'keyword') or (kind = 'bullet' and (under is not null or kw)))) z)
    select doc_id, line_no, name, description, infer from al where length({strip('name')}) > 0"""


def _tidy(x: str) -> str:
    spaced = strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")
    return f"regexp_replace({spaced}, '[–—]', '-', 'g')"


_TYPE_TAIL = " ".join(
    f"when contains({x}, {q(k)}) then {q(k)}" for x in ("nl", "dl") for k in v.MATERIAL_TYPES
)

CLEAN_MATERIALS = f"""
    with a as (select *, lower({strip('name')}) as nl, lower({strip('infer')}) as dl, {_tidy('name')} as n, {_tidy('description')} as d,
                      ({_m('name', v.CITATION)} or {_m('infer', v.CITATION)}) as cited from ({MATERIALS}) x),
    b as (select doc_id, line_no, case when instr(n, ':') > 0 and n = d then {strip("substr(n, 1, instr(n, ':') - 1)")} else n end as name,
                 case when instr(n, ':') > 0 and n = d then {strip("substr(n, instr(n, ':') + 1)")} else d end as description,
                 case when contains(dl, 'optional text') then 'text' when {_m('nl', v.PUBLISHER_IN_NAME)} then 'book'
                      when contains(dl, 'textbook') or contains(nl, 'edition') then 'textbook'
                      when cited and contains(dl, 'course materials') then 'article' when cited then 'textbook'
                      when contains(nl, 'calculator') or contains(dl, 'calculator') then 'equipment'
                      when regexp_matches(nl, 'arcgis|qgis|software') then 'software' when contains(dl, 'digital resource') then 'digital resource'
                      when contains(nl, 'portal') then 'website'
                      when contains(nl, 'documentary') or contains(dl, 'documentary') or starts_with(nl, 'vice:') then 'video'
                      {_TYPE_TAIL} else 'course resource' end as type from a),
    c as (select *, {strip(label('name'))} as cl from b),
    d as (select * from c where name <> '' and cl not in {among(v.IGNORED_MATERIALS)} and not {_m('cl', v.NO_TEXTBOOK)}
            and not (contains(cl, 'canvas') and {_m('cl', any_of(v.GENERIC_CANVAS))} and not {_m('cl', any_of(v.CONCRETE_TERMS))}
                     and not (contains(type, 'textbook') or contains(lower(description), 'textbook')))
            and not ({_m('cl', any_of(v.GENERIC_LITERATURE))} and not {_m('cl', any_of(v.CONCRETE_TERMS))})
            and not (contains(cl, 'reading') and contains(cl, 'assignment')) and not starts_with(cl, '* note') and not starts_with(cl, 'note,')
            and not {_m('cl', v.DATE_LINE)} and not (lower(description) = 'resource for course' and len(regexp_split_to_array(name, '\\s+')) > 8)),
    e as (select *, row_number() over (partition by doc_id, cl order by length(description) desc, line_no) as rn,
                 min(line_no) over (partition by doc_id, cl) as first_line from d)
    select doc_id, first_line as line_no, row_number() over (partition by doc_id order by first_line) as position, name, type, description
    from e where rn = 1"""

CHILDREN = f"""
    select doc_id, 'outcome' as kind, position, goal as name, cast(null as varchar) as detail, cast(null as varchar) as type from ({GOALS}) a
    union all select doc_id, 'assessment', position, name, cast(weight as varchar), null from ({ASSESSMENTS}) b
    union all select doc_id, 'topic', position, topic, null, null from ({CLEAN_TOPICS}) c
    union all select doc_id, 'material', position, name, description, type from ({CLEAN_MATERIALS}) d"""

SQL.update({
    "section_text": DESCRIPTIONS,
    "goal_items": GOALS,
    "topic_items": TOPICS,
    "table_cells": pages.table_cells("select * from @corpus_lines"),
    "table_titles": pages.table_titles("select * from @corpus_lines"),
    "table_weights": pages.table_weights("select * from @corpus_lines"),
    "table_topics": TABLE_TOPICS,
    "clean_topics": CLEAN_TOPICS,
    "assessment_items": ASSESSMENTS,
    "material_items": MATERIALS,
    "clean_materials": CLEAN_MATERIALS,
    "course_children": CHILDREN,
    "course_records": f"""
        select k.doc_id, k.code, k.number, t.title, m.term, m.year, case when k.number >= 500 then 'Graduate' else 'Undergraduate' end as level,
               coalesce(d.description, '') as description, coalesce(n_outcomes, 0) as n_outcomes, coalesce(n_assessments, 0) as n_assessments,
               coalesce(n_topics, 0) as n_topics, coalesce(n_materials, 0) as n_materials
        from ({CODES}) k join ({TITLES}) t using (doc_id) join ({TERMS}) m using (doc_id) left join ({DESCRIPTIONS}) d using (doc_id)
        left join (select doc_id, count(*) filter (where kind = 'outcome') as n_outcomes, count(*) filter (where kind = 'assessment') as n_assessments,
                          count(*) filter (where kind = 'topic') as n_topics, count(*) filter (where kind = 'material') as n_materials
                   from ({CHILDREN}) c group by doc_id) c using (doc_id)""",
    "load_corpus": """
        select doc_id, pos // 40 as page_no, pos % 40 as block_no,
               (pos % 40) / least(40, n - (pos // 40) * 40) as rel_top, md5(lines[pos + 1]) as text_md5
        from (select doc_id, lines, len(lines) as n, unnest(range(0, len(lines))) as pos
              from (select doc_id, string_split(text, chr(10)) as lines from @documents) a) b""",
})
