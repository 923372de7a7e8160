"""URL rules, carried over redirects and canonical links to every alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.components import components
from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import attach

#: (host, path, verdict); a configuration held by the driver.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Tags that link, what makes them count, and their targets; all of it such as other engines' expressions can say too.
_LINK, _META, _BASE = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>", r"(?is)<base\b[^>]*>"
_IS_CANONICAL = r"""(?is)[\s"'/]rel\s*=\s*["']?\s*([^"'>]*\s)?canonical[\s"'/>]"""
_IS_REFRESH = r"""(?is)[\s"'/]http-equiv\s*=\s*["']?refresh[\s"'/>]"""
_HREF = r"""(?is)[\s"'/]href\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)[\s"'/]content\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""
_ABSOLUTE, _OTHER, _DOTS = r"^[A-Za-z][A-Za-z0-9+.-]*://", r"^([A-Za-z][A-Za-z0-9+.-]*:|#)", r"/\.\.?(/|$)"
_ORIGIN, _REST, _FOLDER = r"(?s)^(.*?://[^/?#]*)", r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", r"(?s)^(.*/)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments worked off."""
    parts = F.split(path, "/", -1)
    step = lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    left = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    left = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(left, F.array(F.lit("")))).otherwise(left)
    return F.when(path.rlike(_DOTS), F.array_join(left, "/")).otherwise(path)


def _resolved(target: Column, url: Column) -> Column:
    """An absolute form of a link on the page ``url``; null for what leads to no page, such as mail and fragments."""
    origin = F.regexp_extract(url, _ORIGIN, 1)
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    folder = F.regexp_extract(path_of(url), _FOLDER, 1)
    whole = (F.when(target.rlike(_ABSOLUTE), target)
             .when(target.rlike(_OTHER), F.lit(None).cast("string"))
             .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
             .when(target.startswith("/"), F.concat(origin, target))
             .when(target.startswith("?"), F.concat(origin, path_of(url), target))
             .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target)))
    return F.concat(F.regexp_extract(whole, _ORIGIN, 1), _without_dots(path_of(whole)), F.regexp_extract(whole, _REST, 1))


def _key(url: Column) -> Column:
    """A digest of host and path with query: scheme and fragment do not tell pages apart."""
    return F.md5(F.concat(host_of(url), F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", ""), r"(?s)#.*$", "")))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``a, a_url, b, b_url`` for each redirect (meta refresh) and canonical link of ``pages(url, html)``.

    All of them count, resolved against the page's url or its first base
    element. Pages whose html or url is null, or whose url has no ``://``, have
    no edges.
    """
    html = pages.filter(F.col("url").contains("://") & (F.lower("html").contains("canonical") | F.lower("html").contains("refresh")))
    tags = lambda pattern, counts: F.filter(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), lambda x: x.rlike(counts))
    found = lambda tags, pattern: F.transform(tags, lambda x: F.regexp_extract(x, pattern, 1))
    targets = F.concat(found(tags(_LINK, _IS_CANONICAL), _HREF), found(tags(_META, _IS_REFRESH), _TARGET))
    base = F.regexp_extract(F.regexp_extract("html", _BASE, 0), _HREF, 1)
    plain = lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))
    links = html.select("url", F.coalesce(F.when(base != "", _resolved(plain(base), F.col("url"))), F.col("url")).alias("base"), F.explode(targets).alias("target")).filter("target <> ''")
    links = links.select(F.col("url").alias("a_url"), _resolved(plain(F.col("target")), F.col("base")).alias("b_url")).filter("b_url is not null")
    return links.select(_key(F.col("a_url")).alias("a"), "a_url", _key(F.col("b_url")).alias("b"), "b_url")


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """One verdict per row of ``pages``: ``page_id, host, path, rule, verdict``.

    The longest fitting rule decides. A page that no rule fits is blocked if
    any url is blocked by a rule that redirects and canonical links, followed
    either way and over any number of steps, connect with it; else it is
    allowed. An explicit allow always stands, also inside such a component,
    and stops nothing but the block of its own urls.

    Null urls and urls without ``://`` have empty host and path, fit no rule
    and are allowed; null html has no links. Repeated rows each get their row;
    other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    edges = scratch.keep(alias_edges(own).distinct(), "links")
    judged = own.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    plain = lambda df, inherited: df.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", inherited).alias("verdict"))
    if edges.isEmpty():
        return plain(judged, F.lit("allow"))
    labels = components(edges, scratch)
    urls = edges.select(F.col("a").alias("node"), F.col("a_url").alias("url")).unionByName(edges.select(F.col("b").alias("node"), F.col("b_url").alias("url")))
    blocked = urls.filter(fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"] == "block").select("node").distinct()
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    bad = scratch.keep(blocked.join(labels, "node").select("label").distinct().join(sizes, "label").withColumn("bad", F.lit(True)), "blocked")
    members = attach(labels, bad, ["label"], "size", F.col("node")).select("node", "bad")
    judged = judged.withColumn("node", F.coalesce(_key(F.col("url")), F.lit("")))
    held = scratch.keep(judged.groupBy("node").agg(F.count("*").alias("rows")).join(members, "node"), "members")
    return plain(attach(judged, held, ["node"], "rows", F.col("page_id"), "left"), F.when(F.col("bad"), "block").otherwise("allow"))


def op10(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    """The rules, and a recursive closure of the links, in DuckDB's SQL."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    first = lambda u, pattern, group: f"regexp_extract({u}, {quoted(pattern)}, {group})"
    known = lambda u: f"coalesce({u}, '')"
    host = lambda u: f"translate({first(known(u), _URL, 1)}, '{_UPPER}', '{_LOWER}')"
    path = lambda u: first(known(u), _URL, 2)
    cases = lambda what: " ".join(
        f"WHEN (h = '{h}' OR ends_with(h, '.{h}')) AND starts_with(p, '{r}') THEN '{h + r if what == 'rule' else v}'"
        for h, r, v in sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r)))
    split = lambda u: f"{host(u)} AS h, {path(u)} AS p"
    node = lambda u: f"{host(u)} || regexp_replace(regexp_replace({u}, '(?s)^.*?://[^/?#]*', ''), '(?s)#.*$', '')"

    def resolved(t: str, u: str) -> str:
        folder = first(path(u), _FOLDER, 1)
        return f"""CASE WHEN regexp_matches({t}, '{_ABSOLUTE}') THEN {t} WHEN regexp_matches({t}, '{_OTHER}') THEN NULL
            WHEN starts_with({t}, '//') THEN {first(u, '(?s)^(.*?)://', 1)} || ':' || {t} WHEN starts_with({t}, '/') THEN {first(u, _ORIGIN, 1)} || {t}
            WHEN starts_with({t}, '?') THEN {first(u, _ORIGIN, 1)} || {path(u)} || {t} ELSE {first(u, _ORIGIN, 1)} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {t} END"""

    def clean(u: str) -> str:
        parts = f"string_split({path(u)}, '/')"
        kept = f"""list_reduce([[y] for y in {parts}], lambda a, x: CASE WHEN x[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[:-2] ELSE a END WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END)"""
        dotless = f"array_to_string(CASE WHEN {parts}[-1] IN ('.', '..') THEN list_append({kept}, '') ELSE {kept} END, '/')"
        return f"{first(u, _ORIGIN, 1)} || CASE WHEN regexp_matches({path(u)}, '{_DOTS}') THEN {dotless} ELSE {path(u)} END || {first(u, _REST, 1)}"

    def targets(tag: str, counts: str, target: str) -> str:
        return f"[{first('x', target, 1)} for x in regexp_extract_all(html, {quoted(tag)}) if regexp_matches(x, {quoted(counts)})]"

    return f"""
WITH RECURSIVE found AS (
  SELECT url, replace({first(first('html', _BASE, 0), _HREF, 1)}, '&amp;', '&') AS base, unnest(list_concat({targets(_LINK, _IS_CANONICAL, _HREF)}, {targets(_META, _IS_REFRESH, _TARGET)})) AS t
  FROM pages WHERE contains(url, '://') AND html IS NOT NULL),
based AS (SELECT url, replace(t, '&amp;', '&') AS t, coalesce(CASE WHEN base <> '' THEN {resolved('base', 'url')} END, url) AS base FROM found WHERE t <> ''),
cleaned AS (SELECT url, t, CASE WHEN base = url THEN url ELSE {clean('base')} END AS base FROM based),
links AS (SELECT url, {resolved('t', 'base')} AS b_url FROM cleaned),
l AS (SELECT url AS a_url, {clean('b_url')} AS b_url FROM links WHERE b_url IS NOT NULL),
e AS (SELECT {node('a_url')} AS a, {node('b_url')} AS b FROM l),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
u AS (SELECT a_url AS u, {node('a_url')} AS n FROM l UNION SELECT b_url, {node('b_url')} FROM l),
bad AS (
  SELECT n FROM (SELECT n, CASE {cases('verdict')} END AS v FROM (SELECT n, {split('u')} FROM u)) WHERE v = 'block'
  UNION
  SELECT b FROM bad JOIN both_ways ON a = bad.n)
SELECT page_id, h AS host, p AS path, CASE {cases('rule')} END AS rule,
       coalesce(CASE {cases('verdict')} END, CASE WHEN n IN (SELECT n FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT page_id, {split('url')}, {node("coalesce(url, '')")} AS n FROM pages)
"""


ORACLE = _oracle()
