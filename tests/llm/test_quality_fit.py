"""The quality model learns from every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from veracite.llm import quality


def test_every_labelled_row_takes_part_in_the_fit(spark, monkeypatch):
    rows = [(k, ("plain words stand here " if k % 3 else "!! ## BUY ") * (2 + k % 5) + (" long" * 14000 if k == 7 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)], "doc_id long, quality int")
    never = F.lit(False)
    one, several = quality.fit(docs, labels, never), quality.fit(docs, labels, never, bucket_rows=50)
    x, y = np.array([quality.features(t) for _, t in rows]), np.array([int(k % 3 > 0) for k in range(400)])
    assert np.allclose(one.mean, x.mean(0), atol=1e-4)  # text 7, of more than 60,000 characters, included
    for model in (one, several):
        assert ((model.score(x) >= 0.7) == (y == 1)).mean() > 0.99
    again = quality.fit(docs.repartition(5), labels, never, bucket_rows=50)
    assert np.allclose(again.weights, several.weights) and np.isclose(again.threshold, several.threshold)


def test_each_row_is_in_a_pair_of_each_epoch(monkeypatch):
    monkeypatch.setattr(quality, "PAIRS_PER_EPOCH", 10)
    monkeypatch.setattr(quality, "EPOCHS", 1)
    x, y = np.eye(41), np.array([0] + [1] * 40)
    w = quality.fit_weights(x, y, np.zeros(41), np.ones(41))
    assert (w[1:] > 0).all() and w[0] < 0  # a row left out would leave its own measurement at zero


def test_a_rare_label_reaches_every_bucket(spark):
    docs = spark.createDataFrame([(k, "plain words stand here" if k != 5 else "!! ## BUY") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k != 5)) for k in range(200)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(False), bucket_rows=40)
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs, model).collect()}
    assert got[5] == 0 and sum(got.values()) == 199


def stages(spark):
    """(id, bytes written to shuffles) of the session's latest stages."""
    sc = spark.sparkContext
    got = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [(got.apply(k).stageId(), got.apply(k).shuffleWriteBytes()) for k in range(got.size())]


def test_texts_meet_their_labels_without_a_shuffle_of_texts(spark):
    r = np.random.default_rng(3)
    rows = [(k, " ".join(f"{v:x}" for v in r.integers(0, 2**60, 4000))) for k in range(60)]  # 3.8 MB that hardly compress
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    last, limit = max((k for k, _ in stages(spark)), default=-1), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were too many labels to broadcast
    try:
        assert quality.fit(docs, labels, F.lit(False)) is not None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert 0 < sum(n for k, n in stages(spark) if k > last) < 500_000


def test_documents_without_an_id_or_with_a_shared_one_are_fitted_as_the_labels_say(spark):
    rows = [(1, "plain words stand here"), (1, "more of them"), (2, "!! ## BUY"), (2, None), (3, ""), (None, "no id"), (4, "no label"), (5, "held out")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    got = quality.measured_rows(docs, labels, "quality", F.col("doc_id") == 5).collect()
    want = [("plain words stand here", 1), ("more of them", 1), ("!! ## BUY", 0), ("", 0), ("", 1)]
    assert sorted((bytes(r["x"]), r["key"] & 1) for r in got) == sorted((quality.features(t).astype(np.float32).tobytes(), y) for t, y in want)
    assert len({r["key"] for r in got}) == len(want)
