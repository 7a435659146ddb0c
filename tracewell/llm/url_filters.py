"""Operator 6. URL filters with redirect equivalence (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, connected_components, cut, table

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rules beyond so many are joined by a shuffle, not sent to every executor.
BROADCAST_RULES = 200_000


def url_rest(url: Column) -> Column:
    """What follows the first ://, or the empty string."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url_rest(url), r"^[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """Key of a page in the graph: host, path and query, without scheme and fragment. Null where there is no host."""
    query = F.regexp_extract(url_rest(url), r"^[^?#]*([^#]*)", 1)
    return F.when(url_host(url) != "", F.concat(url_host(url), F.when(url_path(url) == "", "/").otherwise(url_path(url)), query))


def resolved_path(path: Column) -> Column:
    """A path without its dot segments; .. at the top stays there."""
    none = F.array().cast("array<string>")
    steps = F.split(path, "/")
    up = lambda s: F.when(F.size(s) > 1, F.slice(s, 1, F.size(s) - 1)).otherwise(s)
    kept = F.aggregate(steps, none, lambda s, x: F.when(x == "..", up(s)).when(x == ".", s).otherwise(F.concat(s, F.array(x))))
    closed = F.when(path.rlike(r"(^|/)\.{1,2}$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(closed, "/")).otherwise(path)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v) nodes that a page's canonical links and immediate refreshes declare to be the same page.

    A target is absolute if it begins with a scheme, else protocol-relative, root-relative or relative to the page's
    folder; dot segments are resolved.
    """
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    canonical = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), 0)
    refresh = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), 0)
    links = F.concat(
        F.transform(canonical, lambda x: F.regexp_extract(x, r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)),
        F.transform(refresh, lambda x: F.regexp_extract(x, r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)""", 1)),
    )
    found = pages.select(pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).select("url", F.explode(F.array_distinct(F.filter(links, lambda x: x != ""))).alias("to"))
    to, scheme = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&")), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit("://"))
    folder = F.regexp_extract(url_path(url), r"^(.*/)", 1)
    bare, tail = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    rooted = F.when(bare == "", url_path(url)).when(bare.startswith("/"), bare).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), bare))
    target = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).otherwise(F.concat(scheme, url_host(url), resolved_path(rooted), tail))
    return found.select(url_node(url).alias("u"), url_node(target).alias("v")).where("u is not null and v is not null")


def best_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(host, path, ...) with the columns rule and rule_verdict of the longest rule that fits (allow before block at one length).

    A host is looked up by each of its suffixes at a dot; the number of these is bounded by the length of a host.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)))
    rules = rules.select(F.col("host").alias("suffix"), F.struct((F.length("host") + F.length("path")).alias("n"), (F.col("verdict") == "allow").alias("allow"), F.concat("host", "path").alias("rule"), F.col("path").alias("at")).alias("r"))
    known = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    keys = urls.columns
    hits = urls.select(*keys, F.explode(suffixes).alias("suffix")).join(F.broadcast(rules) if known else rules, "suffix").where(F.col("path").startswith(F.col("r.at")))
    best = hits.groupBy("node_key").agg(F.max("r").alias("r"))
    return urls.join(best, "node_key", "left").select(*keys, F.col("r.rule").alias("rule"), F.when(F.col("r.allow"), "allow").when(~F.col("r.allow"), "block").alias("rule_verdict"))


def url_filter(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", edges: DataFrame | None = None) -> DataFrame:
    """Judge every page by host and path rules, and pages without a rule by what their aliases got.

    rules: host, path, verdict (allow or block). redirects: optional (src, dst) urls known from a crawl, beside the
    canonical links and refreshes found in html_col. Returns page_id, host, path, rule, verdict, one row per input row.

    The longest rule decides a page. A page without one takes the verdict of its component over the redirect and
    canonical edges: allow if any alias has an allow rule (explicit allow goes before block), else block if any alias
    has a block rule, else allow. A null or odd url has empty host and path, and is its own component. Repeated rows
    get equal verdicts; columns other than the three named are not read. Empty tables give no rows.

    Distinct urls are judged once; the join back to pages has pages on a side that Spark can split when one url is hot.
    """
    base = pages.select(pages[id_col].alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"))
    urls = base.select("url").distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("url").alias("node_key"))
    judged = best_rule(urls, rules)
    edges = edges if edges is not None else pages.sparkSession.sql("SELECT '' u, '' v WHERE false")
    if html_col is not None:
        edges = edges.unionByName(page_edges(pages, url_col, html_col))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_node(F.col("src")).alias("u"), url_node(F.col("dst")).alias("v")).where("u is not null and v is not null"))
    edges = cut(edges.where("u <> v").distinct())
    verdict = F.coalesce("rule_verdict", F.lit("allow"))
    if not edges.isEmpty():
        judged = cut(judged)
        ruled = best_rule(_named(edges), rules)
        groups = connected_components(edges)
        said = groups.join(ruled.select(F.col("node_key").alias("node"), "rule_verdict"), "node").groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
        alias = groups.join(said, "component").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict"))
        judged = judged.withColumn("node", url_node(F.col("url"))).join(alias, "node", "left")
        verdict = F.coalesce("rule_verdict", "alias_verdict", F.lit("allow"))
    judged = judged.select("url", "host", "path", "rule", verdict.alias("verdict"))
    return base.join(judged, "url").select("page_id", "host", "path", "rule", "verdict")


def _named(edges: DataFrame) -> DataFrame:
    """The nodes of edges as urls to be judged; targets that were never crawled have rules too."""
    nodes = edges.select("u").union(edges.select("v")).distinct()
    url = F.concat(F.lit("http://"), F.col("u"))
    return nodes.select(url_host(url).alias("host"), url_path(url).alias("path"), F.col("u").alias("node_key"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    values = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_table(spark))
