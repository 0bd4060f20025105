import pytest

import corpus_pipeline as C
from loomwork.llm import toxicity
from loomwork.llm.common import BATCH_KEY, Scratch
from loomwork.llm.mixing import oracle
from tests.llm.helpers import SF, empty, odd
from tests.llm.test_lshforest import plain
from tests.oracle import duck_rows


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and what it gave."""
    scratch = Scratch(spark)
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in C.STAGES:
        after = scratch.put(stage(spark, docs, SF))
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(steps):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [s[1].columns for s in steps[:-1]] == [columns] * 4
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece encoding"]
    assert all(len(r.text) == r.n_chars for r in steps[1][1].collect())


def test_toxic_documents_go(spark, steps):
    before, after = steps[0]
    out = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in out.collect() if r.predicted == 0}


def test_no_long_line_is_left_twice(steps):
    seen, before = set(), {r.doc_id: r.text for r in steps[1][0].collect()}
    after = {r.doc_id: r.text for r in steps[1][1].collect()}
    for i in sorted(after):
        lines = {x for x in after[i].split("\n") if len(x.split()) >= 5}
        assert not lines & seen
        seen |= lines
    assert {x for t in before.values() for x in t.split("\n") if len(x.split()) >= 5} == seen


def test_one_of_each_group_stays(steps):
    before, after = steps[2]
    classes = plain([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {c for c, _ in classes.values()}


def test_mixture_equals_sql(spark, steps, tmp_path):
    before, after = steps[3]
    before.write.parquet(str(tmp_path / "d.parquet"))
    sql = oracle(f"'{tmp_path}/d.parquet/*.parquet'", share=C.SHARE, max_epochs=C.EPOCHS, select="SELECT DISTINCT doc_id FROM chosen")
    assert duck_rows(SF, sql)[1] == sorted(repr((r.doc_id,)) for r in after.collect())


def test_ids_decode_to_the_text(steps):
    before, after = steps[4]
    rows = after.collect()
    assert len(rows) == before.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_run_gives_the_last_stage(spark, steps):
    want = sorted((r.doc_id, r.n_tokens) for r in steps[-1][1].collect())
    assert sorted((r.doc_id, r.n_tokens) for r in C.run(spark, SF).collect()) == want


def test_odd_and_empty_tables(spark):
    for docs in (odd(spark), empty(spark)):
        scratch, columns, given = Scratch(spark), docs.columns, docs.count()
        for name, stage in C.STAGES[:-1]:
            docs = scratch.put(stage(spark, docs, SF))
            assert docs.columns == columns
            # The long text is clean; it holds more tokens than the mixture's whole budget.
            assert given == 0 or name == "mixing sources" or 6 in {r.doc_id for r in docs.collect()}
        coded = C.STAGES[-1][1](spark, docs, SF).collect()
        assert len(coded) == docs.count() <= given and all(r.round_trip for r in coded)


def test_encoding_gets_small_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    coded = C.encode(spark, docs, SF)
    assert int(coded.sparkSession.conf.get(BATCH_KEY)) == C.BATCH_BYTES and spark.conf.get(BATCH_KEY, None) is None
    assert coded.join(docs.select("doc_id"), "doc_id").count() == docs.count()
