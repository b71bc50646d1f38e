"""Substring dedup shuffles the texts once, whatever joins meet them."""

import numpy as np

from veracite.llm import substrings


def shuffled(spark):
    """(id, bytes written to shuffles) of the session's latest stages."""
    sc = spark.sparkContext
    got = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [(got.apply(k).stageId(), got.apply(k).shuffleWriteBytes()) for k in range(got.size())]


def test_the_texts_are_shuffled_once(spark):
    r = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k, " ".join(f"{v:x}{v * 7:x}{v * 11:x}" for v in r.integers(0, 2**55, 2000).tolist()) + f" {passage} c{k}") for k in range(40)]
    size = sum(len(t) for _, t in rows)  # hardly compressible
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    last, limit = max((k for k, _ in shuffled(spark)), default=-1), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = substrings.dedup(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {r["n_removed"] for r in got} == {40} and {r["n_words"] for r in got} == {2041}
    written = max(n for k, n in shuffled(spark) if k > last), sum(n for k, n in shuffled(spark) if k > last)
    assert 0.3 * size < written[0] and written[1] < 1.5 * written[0], (size, *written)
