from collections import defaultdict

from loomwork.llm.mixing import deal, mix, mixed_documents, oracle
from loomwork.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import SF, documents, empty, odd
from tests.oracle import same


def test_query_equals_sql(spark):
    assert same(spark, SF, QUERIES["op9_mixing"], ORACLE["op9_mixing"]) > 0


def test_other_parameters_equal_sql(spark):
    for how in ({"share": (15, 10), "max_epochs": 2}, {"share": (3, 10), "max_epochs": 1}, {"share": (9, 1), "max_epochs": 3}):
        query = lambda s, d, how=how: mix(s.read.parquet(f"{d}/documents.parquet"), **how).drop("text_md5")
        same(spark, SF, query, oracle(**how))


def test_deal_against_one_by_one_filling(spark):
    caps, budget, weights = {"a": 10, "b": 100, "c": 100, "d": 0}, 150, {"a": 5, "b": 1, "c": 1}
    df = spark.createDataFrame([(k, v, budget) for k, v in caps.items()], "name string, cap long, budget long")
    got = {r.name: r.budget for r in deal(df, [], "name", weights).collect()}
    assert got == {"a": 10, "b": 70, "c": 70, "d": 0}


def test_budget_and_prefix(spark):
    out = mix(documents(spark), share=(5, 10), max_epochs=2).collect()
    total = sum(r.tokens for r in mix(documents(spark), share=(1, 1), max_epochs=1).collect())
    assert 0 < sum(r.tokens for r in out) <= total
    seen = defaultdict(set)
    for r in out:
        assert r.epoch not in seen[r.doc_id]
        seen[r.doc_id].add(r.epoch)
    assert all(e == set(range(len(e))) or max(e) <= 1 for e in seen.values())


def test_null_ids_do_not_depend_on_partitions(spark):
    rows = [(None, f"text {i} " * (i % 7 + 1), "en", "src1") for i in range(40)] + [(1, "same", "en", "src1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {tuple(sorted(map(str, mix(df.repartition(n), share=(1, 2), max_epochs=1).collect()))) for n in (1, 3, 8)}
    assert len(found) == 1 and 0 < len(next(iter(found))) < len(rows)


def test_odd_and_empty_tables(spark):
    out = mix(odd(spark), share=(2, 1)).collect()  # two whole epochs; the leaves of 3 and 4 have no tokens
    assert sorted((str(r.doc_id), r.tokens, r.epoch) for r in out) == sorted(
        (str(r.doc_id), len((r.text or "").split()), e) for r in odd(spark).collect() for e in (0, 1) if r.doc_id not in (3, 4))
    assert mixed_documents(odd(spark)).columns == odd(spark).columns
    assert mix(empty(spark)).count() == 0
    assert mixed_documents(empty(spark)).count() == 0
