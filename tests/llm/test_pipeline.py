import sys

import pytest

sys.path.insert(0, ".")
import corpus_pipeline as P  # noqa: E402
from helpers import messy  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SMALL).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_pass_documents_on(stages):
    for before, after in stages[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString() and 0 < after.count() <= before.count()
    before, after = stages[-1]
    assert after.count() == before.count() and after.filter("not round_trip").count() == 0


def test_each_stage_keeps_what_its_operator_keeps(spark, stages):
    from fractions import Fraction
    from test_line_dedup import brute as lines
    from test_ngram_join import brute as near
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    classes, want = lines(rows), {}
    for i, t in rows:
        each = t.split("\n")
        kept = [k for k in range(len(each)) if classes[i, k] == (i, k)]
        if len(kept) == len(each) or any(len(each[k]) >= 16 for k in kept):
            want[i] = "\n".join(each[k] for k in kept)
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = stages[2]
    groups = near([(r.doc_id, r.text) for r in before.collect()], 5, Fraction(4, 5))
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in groups.items() if c == i}
    before, after = stages[3]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert {r.doc_id for r in before.collect() if any(x in r.text for x in items)} <= gone


def test_run_returns_the_last_stage(spark, stages):
    got = P.run(spark, SMALL)
    key = lambda df: sorted((r.doc_id, r.text, tuple(r.pieces)) for r in df.collect())
    assert key(got) == key(stages[-1][1])


def test_stages_take_messy_documents(spark):
    docs = messy(spark).drop("item_id")
    for name in ("_id", "_hash", "_gone", "_own", "_hit"):
        docs = docs.withColumn(name, docs["doc_id"])
    for name, stage in P.STAGES:
        out = stage(spark, docs, SMALL)
        assert set(docs.columns) <= set(out.columns), name
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_batches_of_whole_texts_are_bounded_by_bytes(spark, stages):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('abcdefgh', 1000) AS text")
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) <= P.BATCH_BYTES + 16_000
