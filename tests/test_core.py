import json

import pytest
from pyspark.sql import functions as F

from loomwork import functions as L
from loomwork.operators import explode_lines, first_match_per_row, keep_links, pretty_json, to_json_record
from loomwork.operators.records import arch_class
from loomwork.plans import ORACLE, QUERIES
from loomwork.sources import read_lines, read_whole_text, write_json, write_text
from loomwork.streaming import stream_links
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert same(spark, SF, QUERIES[name], ORACLE[name]) > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr.alias("x")).collect()]


def test_tokens(spark):
    assert one(spark, L.last_token(F.col("s")), "a:b:c", "abc", "", None, "a:") == ["c", "", "", None, ""]
    assert one(spark, L.nth_field(F.col("s"), '"', 1), 'a"b"c', "abc", None) == ["b", None, None]
    assert one(spark, L.first_group(F.col("s"), "x(y*)"), "xyy xyyy", "x", "none", None) == ["yy", "", None, None]


def test_routes(spark):
    texts = ["a" * 119, "a" * 120, "a" * 250, "a" * 251, '{"TunnelSecret":1}', "", None]
    assert one(spark, L.route_by_shape(F.col("s")), *texts) == ["default", "token", "token", "default", "secret", "default", "default"]


def test_base64(spark):
    long = "é" * 200
    assert one(spark, L.decode_base64(L.base64_text(F.col("s"))), long, "", "a", None) == [long, "", "a", None]
    assert one(spark, L.decode_base64(F.col("s")), "_-8=", "YWI=")[1] == "ab"


def test_flags_and_names(spark):
    assert one(spark, L.member_flag(F.col("s"), ["443"]), "443", "80", None) == ["tls", "", ""]
    assert one(spark, L.display_name(F.col("s"), F.lit(" x ")), "n", "", None) == ["n-x", "x", "x"]
    assert one(spark, arch_class(F.col("s")), "arm64", "x64", None) == ["arm", "amd", "amd"]
    assert one(spark, to_json_record({"a": F.col("s")}), "v", None) == ['{"a":"v"}', '{"a":null}']


def test_pretty_json(spark):
    value = pretty_json({"a": F.col("s"), "b": [F.lit(1), {"c": F.lit(True)}], "d": {}})
    texts = ['x" : y', None, "é\\\n"]
    want = [json.dumps({"a": t, "b": [1, {"c": True}], "d": {}}, indent=2, ensure_ascii=False) for t in texts]
    assert one(spark, value, *texts) == want


def test_every_arm_of_the_queries_occurs(spark):
    kinds = lambda name, *columns: {tuple(r) for r in QUERIES[name](spark, SF).select(*columns).distinct().collect()}
    assert {r[0] for r in kinds("member_flags", "port_flag")} == {"", "tls"}
    assert kinds("set_guards", "both_set", "one_missing") == {(True, False), (False, True)}
    assert {r[0] for r in kinds("route_shapes", "route")} == {"token", "secret", "default"}
    assert ("",) in kinds("last_tokens", "last")


def test_lines_and_links(spark):
    df = spark.createDataFrame([(1, "a\n\nvless://x", "z"), (2, None, "z"), (3, "", "z")], "id int, text string, line string")
    assert sorted((r.id, r.line_no, r.line) for r in explode_lines(df, "text", ["id"]).collect()) == [(1, 0, "a"), (1, 1, ""), (1, 2, "vless://x"), (3, 0, "")]
    enc = df.select("id", L.base64_text(F.col("text")).alias("e"))
    assert [r.line for r in keep_links(enc, "e", ["id"]).collect()] == ["vless://x"]
    assert [tuple(r) for r in first_match_per_row(df, "text", "(v[a-z]+)", ["id"]).collect()] == [(1, "vless")]


def test_sources_sinks_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("tuic://a",), ("b",)], "value string").coalesce(1)
    write_text(df, str(tmp_path / "t"))
    assert read_lines(spark, str(tmp_path / "t")).count() == 2
    assert read_whole_text(spark, str(tmp_path / "t")).count() == 1
    write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert '"b":null' in read_lines(spark, str(tmp_path / "j")).first()[0]
    q = stream_links(spark, str(tmp_path / "t")).writeStream.format("memory").queryName("links").start()
    q.processAllAvailable()
    q.stop()
    assert [r.line for r in spark.sql("SELECT * FROM links").collect()] == ["tuic://a"]
