"""Operator 6, URL filters: rules by host and path, and redirect equivalence.

A rule names a host (all its subdomains follow) and the start of a path; of those that fit the longest
decides. Canonical links, refresh redirects and tables of redirects are edges between URLs; ``mirror_links``
derives such a table from pages that carry the same article. Their connected components are found by joins,
and a URL without a rule of its own takes the verdict of its component: allow if any alias is allowed by a
rule, else block if any is blocked, else allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import Scratch, components

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Longer lists of rules are joined on the hosts' suffixes instead of being tried one by one in the plan.
INLINE_RULES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; '' for null or without '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' for null or without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none fits. Of equally long ones allow wins."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def with_rule(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, rows: str = "url") -> DataFrame:
    """Add ``r``, the longest rule that fits (as ``rule_of``), to rows with host and path.

    Up to ``INLINE_RULES`` rules are tried in the plan. More of them, or a table of (verdict, host, path), are joined
    with the suffixes of each different host and path, so that any number of rules takes a join and no broadcast.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            return urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    table = rules.select("verdict", F.col("host").alias("__h"), F.col("path").alias("__p")).dropna().distinct()
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.select("host", "path", F.explode(ends).alias("__h")).join(table, "__h").where(F.startswith("path", F.col("__p")))
    name = F.concat("__h", "__p")
    order = F.struct(F.char_length(name).alias("n"), (F.col("verdict") == "allow").alias("a"), name.alias("rule"), "verdict")
    best = met.groupBy("host", "path").agg(F.max(order).alias("b")).select("host", "path", F.struct("b.rule", "b.verdict").alias("r"))
    return urls.join(best, ["host", "path"], "left")


def node_of(url: Column) -> Column:
    """Id of what a server is asked for: host, path and query, whatever the scheme and fragment."""
    return F.md5(F.concat(host_of(url), path_of(url), query_of(url)).cast("binary"))


def resolve(base: Column, link: Column) -> Column:
    """The absolute URL of a link on a page; dots in paths stay as they are."""
    root = F.concat(F.lit("http://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): canonical links and refresh redirects that the pages declare."""
    attr = lambda name: rf"(?is)\b{name}\s*=\s*[\"']?\s*([^\"'\s>]+)"
    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    canonical = tag.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b")
    refresh = tag.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b")
    target = F.when(canonical, F.regexp_extract(tag, attr("href"), 1)).when(refresh, F.regexp_extract(tag, attr("url"), 1))
    found = tags.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("link")).where("link <> ''")
    return found.select(F.col("url").alias("from_url"), resolve(F.col("url"), F.col("link")).alias("to_url"))


ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article>"


def mirror_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): each url whose page has the same article as others, with the least of their urls as its canonical one.

    The article is what stands in the first article element; empty ones, null urls and pages without one give no row.
    A group of n pages gives n - 1 rows. Digests are shuffled, never pages.
    """
    found = pages.where(F.col("url").isNotNull()).select("url", F.regexp_extract("html", ARTICLE, 1).alias("a")).where(F.trim("a") != "")
    held = found.select("url", F.md5(F.col("a").cast("binary")).alias("article"))
    scratch = Scratch(pages.sparkSession)
    held = scratch.put(held)
    least = scratch.put(held.groupBy("article").agg(F.min("url").alias("to_url"), F.count("*").alias("n")).where("n > 1"))
    return held.join(least, "article").where("url <> to_url").select(F.col("url").alias("from_url"), "to_url").distinct()


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict and by_alias of every row, repeated ones too.

    A null url has an empty host and path, no rule, no aliases, and is allowed. A null html declares no
    links. ``redirects`` may add (from_url, to_url) rows; nulls there are left out. ``by_alias`` tells whether
    the verdict is that of a component. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url").dropna())
    links = scratch.put(links)
    placed = lambda df: df.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    own = with_rule(placed(pages.select("page_id", "url")), rules)
    roots = scratch.put(components(
        links.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")), scratch).distinct())
    ends = placed(links.select(F.explode(F.array("from_url", "to_url")).alias("url")).distinct())
    ruled = with_rule(ends, rules).select("node", F.col("r.verdict").alias("v")).where("v IS NOT NULL").distinct()
    verdicts = scratch.put(ruled.join(roots, "node").groupBy("root").agg(F.min("v").alias("alias_verdict")))  # 'allow' sorts before 'block'
    named = scratch.put(roots.join(verdicts, "root").select("node", "alias_verdict"))
    scratch.drop(links, roots, verdicts)
    judged = own.join(named, "node", "left")
    of_alias = F.when(F.col("url").isNotNull() & F.col("r").isNull(), F.col("alias_verdict"))
    return judged.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", of_alias, F.lit("allow")).alias("verdict"),
        of_alias.isNotNull().alias("by_alias"),
    )
