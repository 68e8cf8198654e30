"""URL rules with redirect equivalence: block decisions reach the aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mapwise.llm.graph import components
from mapwise.llm.storage import stored

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict) of the registered query.
RULES = [
    ("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAGS = r"(?i)<(?:link|meta)\b[^>]*>"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def node_of(rest: Column) -> Column:
    """One key for the spellings of a URL: the scheme, the host's case and the fragment do not count."""
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.when(rest != "", F.md5(F.concat(host_of(rest), tail)))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``rule`` and ``rule_verdict`` of the longest rule that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of one length the one with the
    longer host wins, then allow. Each distinct host is looked up once, by its endings, so a hot host costs one row.
    """
    known = rules.select(
        F.col("host").alias("ending"),
        F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
                 (F.col("verdict") == ALLOW).alias("allow"), F.concat("host", "path").alias("rule"),
                 F.col("path").alias("begin"), "verdict").alias("known"))
    labels = F.split("host", r"\.")
    endings = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(endings).alias("ending"))
    per_host = hosts.join(known, "ending").groupBy("host").agg(F.collect_list("known").alias("known"))
    fitting = F.filter("known", lambda r: F.col("path").startswith(r["begin"]))
    return (
        urls.join(per_host, "host", "left").withColumn("best", F.array_max(fitting))
        .withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.verdict")).drop("known", "best"))


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v, rest): each page's node, the node of a canonical link or refresh in its ``html``, and that target's URL rest.

    ``pages`` has (rest, html). Targets may be whole, start with ``//`` or ``/``, or be relative to the page's path.
    """
    tag = pages.select("rest", F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag"))
    value = r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"

    def attribute(pattern: str) -> Column:
        return F.concat(*[F.regexp_extract("tag", pattern + value, k) for k in (1, 2, 3)])

    canonical = F.when(
        F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), attribute(r"(?i)\bhref\s*=\s*"))
    refresh = F.when(
        F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"),
        F.regexp_extract(attribute(r"(?i)\bcontent\s*=\s*"), r"(?i)url\s*=\s*['\"]?([^'\"]+)", 1))
    link = F.replace(F.trim(F.coalesce(canonical, refresh)), F.lit("&amp;"), F.lit("&"))
    found = tag.withColumn("link", link).filter(F.col("link") != "")
    folder = F.regexp_replace(path_of(F.col("rest")), r"[^/]*$", "")
    target = (
        F.when(F.instr("link", "://") > 0, after_scheme(F.col("link")))
        .when(F.col("link").startswith("//"), F.substring("link", 3, 1 << 30))
        .when(F.col("link").startswith("/"), F.concat(host_of(F.col("rest")), "link"))
        .otherwise(F.concat(host_of(F.col("rest")), F.when(folder == "", "/").otherwise(folder), "link")))
    return found.select(node_of(F.col("rest")).alias("u"), target.alias("rest")).withColumn(
        "v", node_of(F.col("rest"))).filter(F.col("u").isNotNull() & F.col("v").isNotNull())


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict): every page judged by rules, then by what its aliases got.

    A page under a rule keeps the rule's verdict, so an explicit allow always holds. Canonical links and refreshes in
    ``html``, and rows of ``redirects`` (source, target) if given, join URLs into components; a page without a rule is
    blocked if any URL of its component, page or mere target, is under a block rule, else allowed. URLs differing in scheme, host case
    or fragment are one. Null URLs and those without ``://`` have an empty host and path, no rule and no alias: allowed.
    Null ``html`` has no links; repeated rows each give a row; other columns are not read.
    """
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    base = pages.select("page_id", after_scheme(F.col("url")).alias("rest"), html.alias("html"))
    edges = link_edges(base.select("rest", "html"))
    if redirects is not None:
        more = redirects.select(node_of(after_scheme(F.col("source"))).alias("u"), after_scheme(F.col("target")).alias("rest"))
        edges = edges.unionByName(more.withColumn("v", node_of(F.col("rest"))).filter("u is not null and v is not null"))
    edges = stored(edges.select("u", "v", "rest"), "url-edges")
    named = components(edges.select("u", "v"), "url-components")

    rows = base.select("page_id", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"),
                       node_of(F.col("rest")).alias("node"))
    known = judged(rows, rules)
    targets = judged(edges.select(host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"),
                                  F.col("v").alias("node")), rules)
    bad = known.select("node", "rule_verdict").unionByName(targets.select("node", "rule_verdict"))
    bad = bad.filter(F.col("rule_verdict") == BLOCK).select("node").distinct()
    blocked = named.join(bad, "node").select("component").distinct()
    aliases = named.join(blocked, "component").select("node", F.lit(BLOCK).alias("passed"))
    return known.join(aliases, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "passed", F.lit(ALLOW)).alias("verdict"))


URL_SQL = r"""
with recursive rules(host, path, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
base as (
  select row_number() over () as r, page_id, html,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
tags as (
  select r, rest, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) as tag from base where rest <> ''),
links as (
  select rest, trim(replace(case
      when regexp_matches(tag, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
        then regexp_replace(regexp_extract(tag, '(?i)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '["'']', '', 'g')
      when regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')
        then regexp_extract(tag, '(?i)url\s*=\s*[''"]?([^''">]+)', 1) end, '&amp;', '&')) as link
  from tags),
targets as (
  select rest as a, case
      when strpos(link, '://') > 0 then substr(link, strpos(link, '://') + 3)
      when starts_with(link, '//') then substr(link, 3)
      when starts_with(link, '/') then regexp_extract(rest, '^[^/?#]*') || link
      else regexp_extract(rest, '^[^/?#]*') || coalesce(nullif(regexp_replace(
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') || link end as b
  from links where link <> ''),
named as (select rest from base where rest <> '' union select b from targets where b <> ''),
nodes as (
  select rest, lower(regexp_extract(rest, '^[^/?#]*')) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
         lower(regexp_extract(rest, '^[^/?#]*')) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as node
  from named),
ruled as (
  select n.*, (select r.host || r.path from rules r
               where (n.host = r.host or ends_with(n.host, '.' || r.host)) and starts_with(n.path, r.path)
               order by length(r.host || r.path) desc, length(r.host) desc limit 1) as rule
  from nodes n),
verdicts as (select u.*, r.verdict from ruled u left join rules r on u.rule = r.host || r.path),
edges as (
  select x.node as u, y.node as v from targets t join nodes x on x.rest = t.a join nodes y on y.rest = t.b
  union select y.node, x.node from targets t join nodes x on x.rest = t.a join nodes y on y.rest = t.b),
bad(node) as (
  select node from verdicts where verdict = 'block'
  union select e.v from bad b join edges e on e.u = b.node)
select b.page_id, coalesce(v.host, '') as host, coalesce(v.path, '') as path, v.rule,
       coalesce(v.verdict, case when v.node in (select node from bad) then 'block' else 'allow' end) as verdict
from base b left join verdicts v on v.rest = b.rest
"""
