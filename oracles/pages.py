"""SQL for tables in text pages."""

from mapwise.functions import vocabulary as v
from mapwise.functions.text import any_of
from oracles.text import among, heading, heading_of, q, strip

WIDEST = 400


def _list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def tables(source: str, keep: str = "") -> str:
    """Rows of cells of the tables in ``source``; ``keep`` is a column that is the same for all lines of a page."""
    kept, held = (f", bool_or({keep}) as {keep}", f", {keep}") if keep else ("", "")
    cell = "regexp_replace(substr(l, starts[i], coalesce(starts[i + 1], width + 1) - starts[i]), '^ +| +$', '', 'g')"
    return f"""
    select doc_id, page_no, row_number() over (partition by doc_id order by first_line) as table_no,
           list_transform(range(1, len(heads) + 1), lambda k: list_transform(range(1, len(starts) + 1), lambda c:
             array_to_string(list_filter(list_transform(list_slice(cells, heads[k], coalesce(heads[k + 1], len(cells) + 1) - 1),
               lambda r: r[c]), lambda x: x <> ''), chr(10)))) as rows{held}
    from (select *, list_filter(range(1, len(cells) + 1), lambda i: i = 1 or cells[i][1] <> '') as heads
      from (select *, list_transform(ls, lambda l: list_transform(range(1, len(starts) + 1), lambda i: {cell})) as cells
        from (select *, list_filter(range(1, width + 1), lambda p: not gap[p] and (p = 1 or (gap[p - 1] and (p = 2 or gap[p - 2])))) as starts
          from (select *, list_transform(range(1, width + 1), lambda p: len(list_filter(ls, lambda l: substr(l, p, 1) not in ('', ' '))) = 0) as gap
            from (select doc_id, page_no, min(line_no) as first_line, max(length(tt)) as width, list(tt order by line_no) as ls{kept}
              from (select *, bool_or(inner_gap) over (partition by doc_id, page_no, run order by line_no) as begun
                from (select *, line_no - row_number() over (partition by doc_id, page_no order by line_no) as run
                  from (select * from (select *, length(tt) <= {WIDEST} and regexp_matches(tt, '[^ ] {{2,}}[^ ]') as inner_gap,
                               length(tt) <= {WIDEST} and regexp_matches(tt, '^ {{2,}}[^ ]') as indented
                    from (select *, coalesce(regexp_replace(replace(text, chr(9), '    '), ' +$', ''), '') as tt from ({source}) s0) s1) s2 where inner_gap or indented) s3) s4) s45
              where begun group by doc_id, page_no, run) s5) s6) s7 where len(starts) > 1) s8) s9"""


def table_cells(source: str) -> str:
    return f"""
    select doc_id, page_no, table_no, row_no, unnest(range(1, len(cells) + 1)) as col_no, unnest(cells) as cell
    from (select doc_id, page_no, table_no, unnest(range(1, len(rows) + 1)) as row_no, unnest(rows) as cells from ({tables(source)}) t) r"""


_FILLED = "lambda x: x <> ''"


def _place(heads: str, names) -> str:
    return f"list_filter(range(1, len({heads}) + 1), lambda i: lower({heads}[i]) in {among(names)})[1]"


def table_titles(source: str) -> str:
    return f"""
    select doc_id, arg_min(title, page_no) as title
    from (select doc_id, page_no, arg_min_null(low[ix], table_no) as title
          from (select *, {_place('head', v.TITLE_TABLE_COLUMNS)} as ix
                from (select *, list_filter(rows[1], {_FILLED}) as head, list_filter(coalesce(rows[2], []), {_FILLED}) as low
                      from ({tables(source)}) t) u) w where ix is not null group by doc_id, page_no) x
    where title is not null group by doc_id"""


def table_weights(source: str) -> str:
    return f"""
    select doc_id, page_no, nth, name, cast(regexp_extract(weight, '([0-9]+\\.?[0-9]*)', 1) as double) as weight
    from (select doc_id, page_no, unnest(range(0, len(items))) as nth, unnest(items).name as name, unnest(items).weight as weight
          from (select doc_id, min(page_no) as page_no, arg_min(items, page_no) as items
                from (select doc_id, page_no, list_filter(flatten(list_transform(pairs, lambda p: list_transform(
                               range(1, least(len(string_split(p.name, chr(10))), len(string_split(p.weight, chr(10)))) + 1),
                               lambda i: struct_pack(name := string_split(p.name, chr(10))[i], weight := string_split(p.weight, chr(10))[i])))),
                             lambda p: not contains(p.weight, '100')) as items
                      from (select doc_id, page_no, arg_min(pairs, table_no) as pairs
                            from (select *, list_filter(list_transform(list_slice(cells, 2, len(cells)),
                                           lambda r: struct_pack(name := r[nm], weight := r[mk])),
                                           lambda p: p.name is not null and coalesce(regexp_matches(p.weight, '[0-9]'), false)) as pairs
                                  from (select *, {_place('cells[1]', v.ASSESSMENT_NAME_COLUMNS)} as nm, {_place('cells[1]', v.ASSESSMENT_MARK_COLUMNS)} as mk
                                        from (select *, list_transform(rows, lambda r: list_filter(r, {_FILLED})) as cells from ({tables(source)}) t) u) w
                                  where nm is not null and mk is not null) x
                            where len(pairs) > 0 group by doc_id, page_no) y) z
                where len(items) > 0 group by doc_id) a) b
    where regexp_matches(weight, '[0-9]')"""


def topic_pages(source: str) -> str:
    n = heading("t")
    page = "over (partition by doc_id, page_no)"
    return f"""
    select * exclude (opened, loose, since, first, last, n), coalesce(page_no >= first and (last is null or page_no <= last)
             and (opened is null or not contents), false) as topic_page
    from (select *, min(page_no) filter (where line_no = since) over (partition by doc_id) as first,
                 min(page_no) filter (where n in {among(v.TOPIC_PAGE_STOPS)} and line_no > since and (opened is null or not contents))
                   over (partition by doc_id) as last
          from (select *, coalesce(opened, loose) as since
                from (select *, min(line_no) filter (where {heading_of('t', v.TOPIC_PAGE_HEADINGS)} and not contents
                               and not (structure and {heading_of('t', ['lecture', 'lectures'])})
                               and not ({heading_of('t', ['schedule', 'course schedule', 'class schedule'])} and times and not signals))
                               over (partition by doc_id) as opened,
                             min(line_no) filter (where n = 'course structure') over (partition by doc_id) as loose
                      from (select *, {n} as n,
                                   bool_or(regexp_matches(lower(text), {q(any_of(v.CONTENTS_PAGES))})) {page} as contents,
                                   bool_or(contains(lower(text), 'course structure')) {page} as structure,
                                   bool_or(regexp_matches(lower(text), {q(any_of(v.CLASS_TIMES) + '|' + v.ROOM_NUMBER)})) {page} as times,
                                   bool_or(regexp_matches(lower(text), {q(v.TOPIC_SIGNALS)})) {page} as signals
                            from (select *, {strip('text')} as t from ({source}) p0) p1) p2) p3) p4) p5"""


def _heading(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(replace(replace(lower({x}), '&', 'and'), '/', ' '), '[%()*:]', '', 'g'), '\\s+', ' ', 'g')")


def _any(head: str, names) -> str:
    return f"list_has_any({head}, {_list(names)})"


def _named(names) -> str:
    return f"list_filter(range(1, len(head) + 1), lambda i: head[i] in {among(names)})"


def _one_line(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


_BAD = "(" + " or ".join(
    f"regexp_matches(lower(x), {q(p)})" for p in ["^(?:" + any_of(v.GOAL_VERBS[:-3]) + ")", *v.NOT_TOPIC_CELLS]) + ")"
_SAMPLED = f"list_filter(list_transform(list_slice(sample, 1, 6), lambda r: {_one_line('r[i]')}), lambda x: x <> '')"
_LOOKS = f"""list_transform(range(1, len(head) + 1), lambda i: struct_pack(n := len({_SAMPLED}),
    good := len(list_filter({_SAMPLED}, lambda x: not {_BAD} and len(regexp_extract_all(x, {q(v.TOPIC_WORD)})) >= 2)),
    bad := len(list_filter({_SAMPLED}, lambda x: {_BAD}))))"""


def _look(i: str, what: str) -> str:
    return f"coalesce(looks[{i}].{what}, 0)"


def _better(i: str, than: str) -> str:
    return f"({_look(i, 'good')} >= 2 and {_look(i, 'bad')} <= {_look(i, 'good')} and {_look(i, 'good')} > {than})"


_LEFT = _better("i - 1", _look("i", "good"))
_RIGHT = _better("i + 1", f"(case when {_LEFT} then {_look('i - 1', 'good')} else {_look('i', 'good')} end)")
_RESCUED = f"""case when {_look('i', 'n')} > 0 and {_look('i', 'good')} >= 1 and {_look('i', 'bad')} <= {_look('i', 'good')} then i
    when {_RIGHT} then i + 1 when {_LEFT} then i - 1 else i end"""

_ITEMS = f"list_transform(ls, lambda x: regexp_replace(x, {q(v.CELL_LIST_MARK)}, chr(1)))"
_MODULES = f"list_transform(ls, lambda x: case when regexp_matches(x, {q(v.CELL_MODULE)}) then chr(1) || x else x end)"


def _marks(x: str) -> str:
    return f"len(list_filter({x}, lambda y: starts_with(y, chr(1))))"


def _parted(x: str) -> str:
    return f"list_filter(list_transform(string_split(array_to_string({x}, ' '), chr(1)), lambda y: {strip('y')}), lambda y: y <> '')"


def table_topics(source: str) -> str:
    known = [*v.TOPIC_COLUMNS, *v.TITLE_COLUMNS, *v.MODULE_COLUMNS, *v.THEME_COLUMNS]
    before = "over (partition by doc_id order by table_no rows between unbounded preceding and 1 preceding)"
    none = "cast([] as bigint[])"
    return f"""
    with t0 as (select * from ({tables(topic_pages(source), 'topic_page')}) x where topic_page),
    t1 as (select *, len(rows) as n, list_transform(rows[1], lambda h: {_heading('h')}) as h1 from t0),
    t2 as (select *, case when n > 2 and not {_any('h1', known)} then
             list_transform(range(1, len(h1) + 1), lambda i: {strip(f"h1[i] || ' ' || {_heading('rows[2][i]')}")}) end as stacked from t1),
    t3 as (select *, coalesce({_any('stacked', v.TOPIC_COLUMNS)}, false) as both_rows from t2),
    t4 as (select *, case when both_rows then stacked else h1 end as own, case when both_rows then 2 else 1 end as skip,
                  last_value(case when n = 1 then h1 end ignore nulls) {before} as cut from t3),
    t5 as (select *, case when not {_any('own', known)} and coalesce(len(cut) = len(own), false) then cut else own end as head
           from t4 where n > 1),
    t6 as (select *, {_any('head', v.TOPIC_COLUMNS)} as topic, {_any('head', v.SCHEDULE_COLUMNS)} as schedule,
                  {_any('head', v.MODULE_COLUMNS)} as modular, {_any('head', v.THEME_COLUMNS)} as theme, {_any('head', v.TITLE_COLUMNS)} as titled,
                  {_any('head', v.ASSESSMENT_COLUMNS)} as graded,
                  {_any('head', v.ITINERARY_COLUMNS)} or {_any(f"flatten(list_transform(list_slice(rows, 1, 12), lambda r: list_transform(r, lambda c: {_heading('c')})))", v.ITINERARY_COLUMNS)} as travel,
                  list_slice(rows, skip + 1, n) as rest from t5),
    t7 as (select *, {_named(v.TOPIC_COLUMNS)} as a1,
                  list_filter({_named(v.MODULE_COLUMNS)}, lambda i: len(list_filter(list_slice(rest, 1, 7), lambda r:
                    not regexp_matches({_one_line('r[i]')}, {q(v.MODULE_LABEL)}) and len(string_split({_one_line('r[i]')}, ' ')) >= 3)) > 0) as a2,
                  case when schedule then {_named(v.THEME_COLUMNS)} else {none} end as a3,
                  case when schedule or topic then {_named(v.TITLE_COLUMNS)} else {none} end as a4,
                  (graded or travel) and not topic as off from t6),
    t8 as (select *, case when off then {none} else list_concat(case when len(a1) > 0 then a1 when len(a2) > 0 then a2 else a3 end, a4) end as found from t7),
    t9 as (select *, coalesce(bool_or(len(found) > 0) {before}, false) as seen from t8),
    t10 as (select *, coalesce(bool_or(off and seen and not (graded and schedule)) over (partition by doc_id, page_no order by table_no
                    rows between unbounded preceding and 1 preceding), false) as ended from t9),
    t11 as (select *, last_value(case when not ended and len(found) > 0 then found end ignore nulls) {before} as prev from t10),
    t12 as (select *, case when len(found) > 0 then found when not off and prev is not null then
                    case when list_max(prev) > len(head) and regexp_matches(rows[1][1], '^[0-9]+(?:\\s|$)') and len(head) > 1 then [2] else prev end end as places
            from t11 where not ended),
    t13 as (select *, case when topic or modular or theme or skip > 1 or titled then rest else rows end as sample,
                   case when topic or modular or theme then rest else rows end as body from t12 where len(places) > 0),
    t14 as (select *, {_LOOKS} as looks from t13),
    t15 as (select *, list_transform(places, lambda i: {_RESCUED}) as spots from t14),
    t16 as (select *, list_filter(range(1, len(spots) + 1), lambda k: list_position(spots, spots[k]) = k) as firsts from t15),
    r1 as (select doc_id, table_no, head, spots, firsts, unnest(range(1, len(body) + 1)) as row_no, unnest(body) as cells from t16),
    r2 as (select doc_id, table_no, row_no, head, cells, unnest(firsts) as k, spots[unnest(firsts)] as i from r1),
    r3 as (select doc_id, table_no, row_no, k, case when {strip("coalesce(cells[i], '')")} = '' and coalesce(head[i] in {among([*v.THEME_COLUMNS, 'topic speaker'])}
                  and i > 1 and head[i - 1] = '' and i <= len(cells), false) then {strip("coalesce(cells[i - 1], '')")} else {strip("coalesce(cells[i], '')")} end as cell from r2),
    r4 as (select *, list_transform(list_filter(list_transform(string_split(cell, chr(10)), lambda x: {strip('x')}),
                    lambda x: x <> '' and not regexp_matches(x, {q(v.CELL_ADMIN)})), lambda x: case when regexp_matches(x, {q(v.CELL_NO_LABS)})
                    then {strip(f"regexp_extract(x, {q(v.CELL_NO_LABS)}, 1)")} else x end) as ls from r3 where cell <> ''),
    r5 as (select doc_id, table_no, row_no, k, case when {_marks(_ITEMS)} > 1 then {_parted(_ITEMS)} when {_marks(_MODULES)} > 1 then {_parted(_MODULES)}
                  else list_filter([{strip("array_to_string(ls, ' ')")}], {_FILLED}) end as parts from r4),
    r6 as (select doc_id, table_no, row_no, k, unnest(range(1, len(parts) + 1)) as nth, unnest(parts) as topic from r5)
    select doc_id, row_number() over (partition by doc_id order by table_no, row_no, k, nth) as line_no, topic from r6"""
