import random
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_decontamination import brute_leaks
from tests.llm.test_quality import brute_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "té") for b in ("ban", "dor", "fil", "gan", "hum", "jen", "kol", "lem", "nuv")]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, item = say(60), say(30)
    texts = [say(r.randrange(60, 160)) for _ in range(60)]
    texts += [texts[0], texts[1] + " lemur", texts[2], say(70) + " " + passage + " " + say(70), say(80) + " " + passage + " " + say(60)]
    texts += [say(60) + " " + item + " " + say(60), say(20), None, "", "kaban " * 80]
    rows = [(i, t, "en", "src" + str(i % 3), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    from tests.llm.test_jaccard import sets_of
    from tests.llm.test_repeats import brute as _  # noqa: F401

    kept = [(i, t) for i, t, ok in brute_quality([(x[0], x[1], x[3]) for x in rows]) if ok]
    sets = {i: sets_of(t, 5) for i, t in kept}
    gone = set()
    for n, (a, _t) in enumerate(kept):
        for b, _u in kept[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                gone.add(b)
    kept = [(i, t) for i, t in kept if i not in gone]
    first, cut = {}, []
    for i, t in kept:
        data = t.encode()
        for p in range(len(data) - 49):
            first[data[p : p + 50]] = min(first.get(data[p : p + 50], i), i)
    for i, t in kept:
        data, mark = t.encode(), [False] * len(t.encode())
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < i:
                mark[p : p + 50] = [True] * 50
        cut.append((i, bytes(c for c, m in zip(data, mark) if not m).decode("utf-8", "ignore")))
    leaked = {d for d, _i in brute_leaks(cut, [(0, item)])}
    expected = {i: t for i, t in cut if i not in leaked and t.strip()}
    assert {i: x["text"] for i, x in out.items()} == expected
    assert leaked and gone and any(len(t) < len(texts[i]) for i, t in expected.items())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(x["token_ids"] == library.encode(x["text"]) and x["parity"] and x["n_chars"] == len(x["text"]) for x in out.values())


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_columns():
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and not re.search("limit", "".join(n for n, _ in corpus_pipeline.STAGES))
