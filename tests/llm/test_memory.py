from sylva.llm import repeats


def test_heap_is_given_back_between_the_stages(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(repeats, "relieve", calls.append)
    text = "a passage of more than fifty bytes that stands in two documents of this table"
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, f"z {text} w")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] > 0 for r in repeats.remove_repeats(docs).collect()} == {1: False, 2: True}
    assert len(calls) == 2
