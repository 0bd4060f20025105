import random

import duckdb

from loomwork.llm.oracles import URLS
from loomwork.llm.queries import QUERIES
from loomwork.llm.urls import RULES, filter_urls, mirror_links, page_links
from tests.llm.helpers import LONG, SF
from tests.oracle import same

COLUMNS = "page_id long, url string, html string, node string, root string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], COLUMNS)


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_rules(spark):
    got = verdicts(filter_urls(pages(
        spark, ("HTTPS://A.Example.ORG/es/1?q#f", ""), ("http://example.org/en/19", ""), ("http://example.org/en/2", None),
        ("http://x.com/de/1", ""), ("http://x.com/fr/1", ""), ("http://x.com", ""), ("nothing", ""), (None, ""), ("http://", ""),
        ("http://myexample.org/es/1", ""), ("http://É.com/de/://b/c", ""), ("x://h?/p://z", ""),
    )))
    assert got == {
        0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/19", "example.org/en/1", "block"),
        2: ("example.org", "/en/2", "org/", "allow"), 3: ("x.com", "/de/1", "com/de/", "block"), 4: ("x.com", "/fr/1", "com/fr/", "allow"),
        5: ("x.com", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("myexample.org", "/es/1", "org/", "allow"), 10: ("É.com", "/de/://b/c", "com/de/", "block"), 11: ("h", "", None, "allow"),
    }


def test_aliases(spark):
    df = pages(
        spark,
        ("http://a.net/1", '<link rel="canonical" href="http://x.com/de/1">'),  # of a blocked url that is no page
        ("http://b.net/1", '<meta http-equiv="refresh" content="0; url=http://a.net/1">'),  # two steps away
        ("http://c.net/1", "<LINK href='/2' REL=canonical>"), ("http://c.net/2", '<link rel=canonical href="http://x.com/fr/9">'),
        ("https://d.net/1#part", '<link rel="canonical" href="http://x.com/de/2"><link rel=canonical href="http://x.com/fr/2">'),
        ("http://e.net/1", None), ("http://f.net/1", "canonical"), ("https://a.net/1", ""),
    )
    got = verdicts(filter_urls(df))
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert {r[0]: r[1:] for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({URLS})").fetchall()} == got
    got = {k: v[3] for k, v in got.items()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block"}
    more = spark.createDataFrame([("http://e.net/1", "http://x.com/de/7"), (None, "http://x.com/de/7")], "from_url string, to_url string")
    assert verdicts(filter_urls(df, redirects=more))[5][3] == "block"


def test_long_chain_and_relative_links(spark):
    chain = [(f"http://n{i}.net/a/b", f'<link rel="canonical" href="//n{i + 1}.net/a/b">') for i in range(30)]
    chain.append(("http://n30.net/a/b", '<link rel="canonical" href="http://q.com/de/">'))
    assert {v[3] for v in verdicts(filter_urls(pages(spark, *chain))).values()} == {"block"}
    links = page_links(pages(spark, ("http://h.net/a/b?x", '<link rel=canonical href="c?d=1&amp;e=2">')).select("url", "html")).first()
    assert links.to_url == "http://h.net/a/c?d=1&e=2"


def test_empty_and_real(spark):
    assert filter_urls(spark.createDataFrame([], COLUMNS)).count() == 0
    real = spark.read.parquet(f"{SF}/pages.parquet")
    assert filter_urls(real).count() == real.count()


def test_mirrors(spark):
    body = "<html><ARTICLE id=x>the same</article>"
    df = pages(
        spark, ("http://a.net/1", body), ("http://b.com/de/1", body), ("http://c.net/1", body + "<article>more</article>"), ("http://d.net/1", "<article> </article>"),
        ("http://e.net/1", "<article> </article>"), ("http://f.com/de/2", None), (None, body), ("http://a.net/1", body),
    )
    assert {tuple(r) for r in mirror_links(df).collect()} == {("http://b.com/de/1", "http://a.net/1"), ("http://c.net/1", "http://a.net/1")}
    out = filter_urls(df, redirects=mirror_links(df)).collect()
    assert {r.page_id: (r.verdict, r.by_alias) for r in out} == {
        0: ("block", True), 1: ("block", False), 2: ("block", True), 3: ("allow", False), 4: ("allow", False), 5: ("block", False), 6: ("allow", False), 7: ("block", True)}
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert sorted(con.execute(f"SELECT page_id, verdict, by_alias FROM ({URLS})").fetchall()) == sorted((r.page_id, r.verdict, r.by_alias) for r in out)


def test_many_rules_are_joined(spark):
    rng = random.Random(1)
    hosts, paths = ["com", "x.com", "a.x.com", "net", "b.net", "org"], ["/", "/a", "/a/b", "/c/"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.6}.values())
    more = rules + [("block", f"host{i}.example", "/") for i in range(2000)]
    df = pages(spark, *((f"http://{s}{h}{p}{t}", LONG if k == 0 else None) for k, (s, h, p, t) in enumerate(
        (s, h, p, t) for s in ("", "w.", "host7.example.", "n") for h in hosts for p in ("", *paths) for t in ("", "x", "?y"))), ("http://host7.example/1", ""), (None, None), (None, None))
    few = verdicts(filter_urls(df, [*rules, ("block", "host7.example", "/")]))
    table = spark.createDataFrame(more, "verdict string, host string, path string")
    assert few == verdicts(filter_urls(df, more)) == verdicts(filter_urls(df, table))
    assert any(v[2] is None for v in few.values()) and few[max(few) - 2][2] == "host7.example/"


def test_aliases_decide_some_pages(spark):
    assert QUERIES["op6_urls"](spark, SF).where("by_alias").count() > 0


def test_query_equals_sql(spark):
    assert same(spark, SF, QUERIES["op6_urls"], URLS) > 0
