"""How much the n-gram join shuffles: shuffle files stay until the driver happens to collect its garbage, so all of them together have to fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")


def _stages(spark):
    """Bytes that each stage so far has shuffled."""
    sc = spark.sparkContext
    done = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(done.apply, range(done.size()))}


@pytest.fixture
def no_broadcasts(spark):
    """Small tables are joined as large ones are."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_texts_in_no_pair_are_not_shuffled(spark, tmp_path, no_broadcasts):
    from palimpsest.llm.jaccard import jaccard_components

    rng = np.random.default_rng(41)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 300)) for _ in range(3000)]
    copies = [(10_000 + i, f"{texts[i]} and a few more words") for i in range(0, 90, 3)]  # near enough
    halves = [(20_000 + i, " ".join(texts[i].split()[:200])) for i in range(1, 90, 3)]  # not near enough
    spark.createDataFrame([*enumerate(texts), *copies, *halves], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    before = _stages(spark)
    got = {r[0]: r[2] for r in jaccard_components(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    shuffled = sum(n for k, n in _stages(spark).items() if k not in before)
    assert got == {i: i for i in range(3000)} | {i: i - 10_000 for i, _ in copies} | {i: i for i, _ in halves}
    assert shuffled < 1.5 * sum(map(len, texts))


def test_asked_texts_are_all_kept(spark):
    """Keys of any sign, rows without an id, and copies of an asked text under other ids."""
    from palimpsest.llm.jaccard import _asked_for
    from palimpsest.llm.shared import row_key

    data = [(None if i % 50 == 0 else i - 2000, f"text {i % 1000}") for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    asked = docs.where("text like '%7' and (doc_id < 0 or doc_id is null)")
    wanted, got = {(r["doc_id"], r["text"]) for r in asked.collect()}, {(r["doc_id"], r["text"]) for r in _asked_for(docs, asked).collect()}
    assert wanted <= got and len(got) < len(wanted) + 5 and _asked_for(docs, asked).columns == docs.columns
    assert _asked_for(docs, asked.limit(0)).count() == 0
    assert _asked_for(docs, docs).count() == len(data)
