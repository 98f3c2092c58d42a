"""URL rules, and block decisions that spread over redirects and canonical links.

A page's own longest rule decides. For a page that no rule fits, the decision comes from its aliases: the urls that
redirects and canonical links connect it with, found as connected components over all such links. One alias that a
rule allows lets the whole class pass; otherwise one blocked alias blocks it; otherwise it is allowed.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm.cluster import components, map_arrow
from emberfield.llm.html_text import HEAD, RAW, TAG
from emberfield.scale import cut_lineage, ship_if_small

ALLOW, BLOCK = "allow", "block"
# The rules of the registered query.
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]
# Query parameters that tell where a visitor came from and never what is shown.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|msclkid)"

# Up to so many rules are one expression in the row; more are joined by host.
RULES_IN_ROW = 200
RULE_SCHEMA = "host string, path string, verdict string"

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_REFRESH = re.compile(r"""^\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?["']?([^"']+)""", re.IGNORECASE)
_SKIPPED = RAW | {"noscript", "template"}


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """(host, path, verdict) of rules written as (verdict, host/path)."""
    rows = [(host, "/" + path, verdict) for verdict, (host, _, path) in ((v, r.partition("/")) for v, r in rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def resource(url: Column) -> Column:
    """The address that a server sees: scheme and host in lower case, no default port, at least /, no fragment; null without a host."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    port = F.when(scheme == "http", r":80$").when(scheme == "https", r":443$").otherwise(r"$^")
    host = F.regexp_replace(host_of(url), port, F.lit(""))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host, path, query))


def untracked(address: Column) -> Column:
    """An address without its tracking parameters."""
    without = F.regexp_replace(address, rf"(?i)(?<=[?&]){TRACKING}=[^&]*&?", "")
    return F.regexp_replace(without, r"[?&]$", "")


def declared(url: str, html: str) -> list[str]:
    """The targets that a page's head names: its first canonical link and its first refresh, as absolute urls."""
    base, found, at = url, {}, 0
    while m := TAG.search(html, at):
        at = m.end()
        name = (m["name"] or "").lower()
        if not name or name in ("html", "head") and not m["close"]:
            continue
        if name not in HEAD:
            break  # the head ends here
        if name in _SKIPPED and not m["close"]:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m["rest"] or "")}
        target = None
        if name == "link" and "canonical" in values.get("rel", "").lower().split():
            target = values.get("href")
        elif name == "meta" and values.get("http-equiv", "").strip().lower() == "refresh":
            refresh = _REFRESH.match(values.get("content", ""))
            target = refresh.group(1) if refresh else None
        try:
            if name == "base" and "href" in values:
                base = urljoin(url, values["href"].strip())
            elif target:
                found.setdefault(name, urljoin(base, target.strip()))
        except ValueError:  # no address
            pass
    return list(found.values())


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(u.as_py(), t) for u, h in zip(batch.column(0), batch.column(1), strict=True) for t in declared(u.as_py(), h.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["a", "b"])


def alias_links(pages: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): urls that are one page: canonical links and refreshes in the html, urls that differ in tracking
    parameters only, and the rows (from_url, to_url) of ``redirects``."""
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).filter("url is not null")
    named = rows.filter(F.col("html").rlike("(?i)canonical|http-equiv"))
    found = map_arrow(named, _links, "a string, b string")
    plain = untracked(resource(F.col("url")))
    found = found.unionByName(rows.filter(F.col("url").rlike(f"(?i)[?&]{TRACKING}=")).select(F.col("url").alias("a"), plain.alias("b")))
    if redirects is not None:
        found = found.unionByName(redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")))
    return found.filter("a is not null and b is not null").distinct()


def _best(fits: Column) -> Column:
    """Of (length, verdict, rule) structs the longest rule's; an allowing one among equally long ones."""
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["verdict"] == ALLOW).alias("allow"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def with_rule(urls: DataFrame, rules: DataFrame, url: str = "url", in_row: int = RULES_IN_ROW) -> DataFrame:
    """The rows with ``_rule`` and ``_verdict`` of the longest rule that fits, null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Few rules are tested in the row;
    of many, those of the host's suffixes are looked up by join, once per distinct host and path.
    """
    rules = cut_lineage(rules.select("host", "path", "verdict").filter("host is not null and path is not null and verdict is not null").distinct())
    count = rules.count()
    host, path = host_of(F.col(url)), path_of(F.col(url))
    if count <= in_row:
        fits = [
            F.when(((F.col("_host") == r["host"]) | F.col("_host").endswith("." + r["host"])) & F.startswith("_path", F.lit(r["path"])), F.struct(F.lit(r["host"] + r["path"]).alias("rule"), F.lit(r["verdict"]).alias("verdict")))
            for r in rules.collect()  # at most in_row
        ]
        best = _best(F.filter(F.array(*fits), lambda r: r.isNotNull())) if fits else F.lit(None).cast("struct<n:int,allow:boolean,rule:string,verdict:string>")
        return urls.withColumns({"_host": host, "_path": path}).withColumn("_best", best).select(*urls.columns, F.col("_best.rule").alias("_rule"), F.col("_best.verdict").alias("_verdict"))
    known = urls.withColumns({"_host": host, "_path": path})
    places = known.select("_host", "_path").distinct()
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = places.withColumn("host", F.explode(suffixes))
    hits = asked.join(ship_if_small(rules, count), "host").filter(F.startswith("_path", "path"))
    rule = F.concat("host", "path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == ALLOW).alias("allow"), rule.alias("rule"), "verdict"))
    found = hits.groupBy("_host", "_path").agg(best.alias("_best"))
    return known.join(found, ["_host", "_path"], "left").select(*urls.columns, F.col("_best.rule").alias("_rule"), F.col("_best.verdict").alias("_verdict"))


def alias_verdicts(links: DataFrame, rules: DataFrame, in_row: int = RULES_IN_ROW) -> DataFrame:
    """(address, verdict) of every linked url's class that holds an allowed or a blocked one."""
    key = lambda c: F.unhex(F.md5(resource(F.col(c))))
    links = cut_lineage(links.select("a", "b", key("a").alias("ka"), key("b").alias("kb")).filter("ka is not null and kb is not null"))
    parts = components(links, "ka", "kb")
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("url"), F.col("ka").alias("vertex")), F.struct(F.col("b").alias("url"), F.col("kb").alias("vertex")))).alias("end")).select("end.*").distinct()
    judged = with_rule(ends, rules, in_row=in_row).filter("_verdict is not null").select("vertex", F.col("_verdict").alias("own")).distinct()
    decided = judged.join(parts, "vertex").groupBy("component").agg(F.min("own").alias("verdict"))  # "allow" comes before "block"
    return parts.join(decided, "component").select(F.col("vertex").alias("_address"), F.col("verdict").alias("_inherited"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", in_row: int = RULES_IN_ROW) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has (host, path, verdict "allow" or "block"); the longest one that fits a page decides (an allowing one
    among equally long ones) and is named as host + path. A page without one gets its aliases' verdict, allow first,
    then block, and is allowed otherwise. ``redirects`` may add pairs (from_url, to_url) that a crawler followed.

    A null url or one without :// has an empty host and path, fits no rule and is allowed. Null and empty html names
    no links. Repeated rows are judged each; rules with null fields are left out; other columns are ignored. An empty
    table gives an empty table.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    own = with_rule(rows, rules, in_row=in_row)
    links = cut_lineage(alias_links(pages, redirects, url, html))
    out = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("_rule").alias("rule"), "_verdict", F.unhex(F.md5(resource(F.col("url")))).alias("_address"))
    if links.isEmpty():
        return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.lit(ALLOW)).alias("verdict"))
    out = out.join(cut_lineage(alias_verdicts(links, rules, in_row)), "_address", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", "_inherited", F.lit(ALLOW)).alias("verdict"))


URL_FILTER_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, COALESCE(url, '') AS url,
    translate(regexp_extract(COALESCE(url, ''), '^(?:.|\n)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(COALESCE(url, ''), '^(?:.|\n)*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
v AS (
  SELECT page_id, url, host, path,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    CASE WHEN host <> '' THEN regexp_replace(url, '#.*$', '') END AS a
  FROM p),
t AS (
  SELECT DISTINCT a, regexp_replace(regexp_replace(a, '([?&])(utm_[a-z]+|gclid|fbclid|msclkid)=[^&]*&?', '\1', 'g'), '[?&]$', '') AS b
  FROM v WHERE a IS NOT NULL),
n AS (SELECT a AS x, b AS y FROM t UNION SELECT b, a FROM t),
r(x, y) AS (SELECT x, y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON n.x = r.y),
o AS (SELECT a, MIN(CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' ELSE 'block' END) AS own FROM v WHERE rule IS NOT NULL GROUP BY a),
i AS (SELECT r.x AS a, MIN(o.own) AS inherited FROM r JOIN o ON o.a = r.y GROUP BY r.x)
SELECT v.page_id, v.host, v.path, v.rule,
  COALESCE(CASE WHEN v.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN v.rule IS NOT NULL THEN 'block' END, i.inherited, 'allow') AS verdict
FROM v LEFT JOIN i ON v.a = i.a
"""
