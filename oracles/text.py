"""SQL expressions over document lines, shared by the extraction."""

from mapwise.functions import vocabulary as v


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def upper(x: str) -> str:
    return f"(regexp_matches({x}, {q(v.UPPER)}) and not regexp_matches({x}, {q(v.LOWER)}))"


def title(x: str) -> str:
    return f"(regexp_matches({x}, {q(v.UPPER)}) and not regexp_matches({x}, {q(v.TITLE_BREAK)}))"


def words(x: str) -> str:
    return f"(case when length({x}) = 0 then 0 else len(regexp_split_to_array({x}, '\\s+')) end)"


def label(x: str) -> str:
    return f"regexp_replace(lower({x}), ':+$', '')"


def heading(x: str) -> str:
    return f"regexp_replace({label(x)}, {q(v.SECTION_NUMBER)}, '')"


def heading_of(x: str, items) -> str:
    n = heading(x)
    return f"""({n} in {among(items)} or (instr({n}, ':') > 0 and {strip(f"substr({n}, instr({n}, ':') + 1)")} in {among(items)}))"""


def boundary(x: str, stops, expected) -> str:
    n = heading(x)
    return f"""(length({n}) > 0 and {n} not in {among(expected)} and ({n} in {among(stops)} or ({words(strip(n))} <= 6
               and ({upper(x)} or regexp_matches({x}, {q(v.NUMBERED_TITLE)})))))"""


def bullet_class(x: str) -> str:
    m = f"regexp_extract({x}, {q(v.BULLET)}, 1)"
    return f"""case when length({m}) = 0 then null
        when regexp_matches({m}, '^[(]?[0-9]') then 'number' || cast(length({m}) - length(replace({m}, '.', '')) as varchar)
        when regexp_matches({m}, '^\\(') then 'letter' else {m} end"""
