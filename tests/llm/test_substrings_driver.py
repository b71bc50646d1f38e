"""The driver of substring dedup holds passages, no automaton."""

from veracite.llm import substrings


def test_the_automaton_is_built_by_the_workers(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(k, f"a{k} b{k} {passage} c{k}") for k in range(30)], "doc_id long, text string")
    monkeypatch.setattr(substrings, "HOT_COUNT", 4)
    monkeypatch.setattr(substrings, "Automaton", None)  # of the driver's module only
    got = substrings.dedup(docs, with_text=True).collect()
    assert {r["n_removed"] for r in got} == {40} and {r["text"] for r in got} == {f"a{k} b{k} c{k}" for k in range(30)}
