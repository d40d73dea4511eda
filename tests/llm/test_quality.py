import random
import re

from sylva.llm import quality as q
from sylva.runtime import materialise, ship

WORD = re.compile("[^\x20\x09-\x0d]+")


def stats(text):
    t = text or ""
    w = WORD.findall(t)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def brute_quality(rows):
    """(id, text, kept) without host verdicts, for rows whose hosts are all sound."""
    out = []
    for i, t, _ in rows:
        n, _c, _s, _d, rep = stats(t)
        out.append((i, t, not (n < 50 or 100 * rep > 50 * n)))
    return out


def corpus():
    r = random.Random(4)
    vocabulary = ["a", "bé", "c|d", "#", "of", "the", "x*y", "ñ"]
    texts = [" ".join(r.choice(vocabulary) + r.choice(["", "", "\n", "\t\r"]) for _ in range(r.randrange(150))) for _ in range(80)]
    return texts + ["", None, " \n\t", "line one\nline one\nline one\r", "a b a b a b", "same same same", "x" * 50000, " ".join(f"w{i}" for i in range(3000))]


def test_statistics(spark):
    ship(spark)
    rows = [(i, t, None if i % 5 == 0 else f"h{i % 3}") for i, t in enumerate(corpus())]
    out = q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), settle=materialise).collect()
    assert len(out) == len(rows)
    for r in out:
        s = stats(rows[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == s
        assert r["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert r["kept"] == (not r["base_failed"] and not r["host_rejected"])


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(q.F, "xxhash64", lambda *words: q.F.length(words[0]).cast("long"))
    rows = [(i, t, "h") for i, t in enumerate(corpus()[:40])]
    out = q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in out} == {i: stats(t)[4] for i, t, _ in rows}


def test_bad_hosts_go_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short" if i % 10 < 9 else good, "bad") for i in range(200)] + [(1000 + i, good, f"h{i % 20}") for i in range(400)]
    rows += [(5000, "short", "tiny"), (5001, "short", None), (5002, good, None)]
    out = {r["doc_id"]: r for r in q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), settle=materialise).collect()}
    assert not any(out[i]["kept"] for i in range(200)) and all(out[1000 + i]["kept"] for i in range(400))
    assert not out[5000]["host_rejected"] and out[5002]["kept"]


def test_many_hosts_by_shuffle(spark):
    rows = [(i, "short", "bad") for i in range(100)] + [(500 + i, " ".join(f"w{k}" for k in range(60)), "good") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = q.quality(df, q.Rules(broadcast_hosts=0), settle=materialise)
    assert out.filter("kept").count() == 100 and out.filter("host_rejected").count() == 100 and out.count() == 200


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, host string, failed int, _stats int")
    assert q.quality(df, settle=materialise).count() == 0


def test_clashing_names_and_long_texts(spark):
    names = ("n_words", "stats", "own", "host", "failed", "_host", "_stats", "host_rejected", "kept", "_salt")
    long = " ".join(f"w{i}" for i in range(40_000)) + " one two three one two three"
    rows = [(1, long, "a", *["x"] * len(names)), (2, "short", "b", *["y"] * len(names)), (3, long, None, *["z"] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for rules in (q.Rules(), q.Rules(broadcast_hosts=0)):
        out = q.quality(df, rules, keep=("doc_id", "host", "_host", "n_words"), settle=materialise)
        assert out.columns == ["doc_id", "host", "_host", *q.STATS, "base_failed", "kept", "host_rejected"]
        assert {(r["doc_id"], r["host"], r["n_words"], r["n_repeat_words"], r["kept"]) for r in out.collect()} == {(1, "x", 40_006, 6, True), (2, "y", 1, 0, False), (3, "z", 40_006, 6, True)}
        left = q.kept_documents(df, materialise, rules)
        assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3]
