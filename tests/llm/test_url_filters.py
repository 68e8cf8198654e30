import os

import duckdb

from mapwise.llm import url_filters as uf
from mapwise.llm.queries import SQL, op4_url_filters


def link(target):
    return f'<head><link rel="canonical" href="{target}"></head>'


PAGES = [
    (1, "https://a.example.org/x", link("http://b.example.org/y")),
    (2, "http://B.example.org/y#top", link("https://m.example.com/en/bad?x=1&amp;y=2")),  # the target is under a block rule
    (3, "http://www.example.com/en/1", link("http://a.example.org/x")),  # explicit allow in a blocked component
    (4, "http://a.example.org/x", None),
    (5, "http://other.org/q", '<META content="0; url=/r" http-equiv=refresh>'),
    (6, "ftp://other.org/r", None),
    (7, None, link("http://m.example.com/en/bad")), (8, "no scheme", None), (9, "", ""), (10, "http://net/es/", None),
    (11, "http://x.NET/fr/a?b#c", None), (12, "http://xnet/fr/", None), (13, "http://example.com", None),
    (14, "http://example.com?/en/", None), (15, "http://c.org/d/e", link("f?g")), (16, "http://c.org/d/f?g", link("//h.net/fr/z")),
    (6, "ftp://other.org/r", None), (None, "http://m.example.com/en/q", None),
]


def test_rules_aliases_and_sql(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, rule string")
    got = sorted((tuple(r) for r in uf.filter_urls(pages, uf.rules_frame(spark)).collect()), key=str)
    verdicts = {r[0]: (r[3], r[4]) for r in got}
    assert verdicts[1] == verdicts[2] == verdicts[4] == (None, "block")
    assert verdicts[3] == ("www.example.com/en/", "allow")
    assert verdicts[5] == verdicts[6] == verdicts[7] == verdicts[8] == verdicts[9] == verdicts[12] == (None, "allow")
    assert verdicts[10] == ("net/es/", "block") and verdicts[11] == ("net/fr/", "block")
    assert verdicts[13] == verdicts[14] == (None, "allow") and verdicts[15] == verdicts[16] == (None, "block")
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    assert got == sorted((tuple(r) for r in con.execute(SQL["op4_url_filters"]).fetchall()), key=str)


def test_redirect_chain(spark):
    pages = spark.createDataFrame([(i, f"http://s{i}.org/") for i in range(40)], "page_id long, url string")
    hops = spark.createDataFrame(
        [(f"http://s{i}.org/", f"http://s{i + 1}.org/") for i in range(30)] + [("http://s30.org/", "http://x.net/es/1"), (None, "x")],
        "source string, target string")
    got = {r.page_id: r.verdict for r in uf.filter_urls(pages, uf.rules_frame(spark), hops).collect()}
    assert got == {i: "block" if i <= 30 else "allow" for i in range(40)}


def test_whole_table_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in op4_url_filters(spark, folder).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{os.path.join(folder, 'pages.parquet')}'")
    assert got == sorted((tuple(r) for r in con.execute(SQL["op4_url_filters"]).fetchall()), key=str)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert uf.filter_urls(pages, uf.rules_frame(spark)).count() == 0
