import random
import re
from collections import Counter

import pytest

from sylva.llm import decontamination as dc
from sylva.runtime import ship


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_leaks(docs, items, limit=0.8):
    found = {}
    for d, t in docs:
        w = words(t)
        for item, text in items:
            v = words(text)
            if not v:
                continue
            k = min(5, len(v))
            own = grams(v, k)
            for s in range(max(len(w) - len(v), 0) + 1):
                other = grams(w[s : s + len(v)], k)
                both, total = sum((own & other).values()), sum((own | other).values())
                if total and both / total >= limit - 1e-9 and both / total > found.get((d, item), (0, 0))[0]:
                    found[d, item] = (both / total, s)
    return found


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_against_every_window(spark, monkeypatch, broadcast):
    ship(spark)
    monkeypatch.setattr(dc, "BROADCAST_ROWS", broadcast)
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    items = [(i, say(k)) for i, k in enumerate((3, 5, 9, 20, 33, 40, 40))] + [(7, None), (8, ""), (9, "w1 w1 w1 w1 w1 w1 w1"), (10, "unique")]
    docs = []
    for d in range(60):
        t = (r.choice(items)[1] or "").split()
        if t and r.random() < 0.5:
            t[r.randrange(len(t))] = "edited"
        if r.random() < 0.2:
            t.insert(len(t) // 2, "more")
        docs.append((d, f"{say(r.randrange(30))}, {' '.join(t).title()}. {say(r.randrange(30))}"))
    docs += [(100, None), (101, ""), (102, items[3][1]), (103, " ".join(["w1"] * 40)), docs[0]]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): round(x["similarity"], 6) for x in got} == {k: round(s, 6) for k, (s, _) in brute_leaks(docs, items).items()}
    texts, benchmark = dict(docs), dict(items)
    for x in got:  # the window named is as similar as said
        v, w = words(benchmark[x["item_id"]]), words(texts[x["doc_id"]])
        own, other = grams(v, min(5, len(v))), grams(w[x["start"] : x["start"] + len(v)], min(5, len(v)))
        assert abs(sum((own & other).values()) / sum((own | other).values()) - x["similarity"]) < 1e-6


def test_rows_that_stay(spark):
    ship(spark)
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven y", 1), (2, "clean text of one two", 2), (3, None, 3)], "doc_id long, text string, item_id int")
    assert {r["doc_id"] for r in dc.without_leaks(docs, items).collect()} == {2, 3}
    assert dc.without_leaks(docs, items.limit(0)).count() == 3
    assert dc.leaks(docs.limit(0), items).count() == 0


def test_no_python_in_the_plan(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven y")], "doc_id long, text string")
    plan = dc.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_blocks_find_all_within_the_radius(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = []
    for _ in range(300):
        x = y = r.getrandbits(64)
        for b in r.sample(range(64), r.randrange(dc.RADIUS + 1)):
            y ^= 1 << b
        pairs.append((signed(x), signed(y)))
    df = spark.createDataFrame(pairs, "x long, y long")
    shared = lambda a, b: F.arrays_overlap(dc.block_keys(a, dc.WINDOW_FLIPS), dc.block_keys(b, dc.ITEM_FLIPS))
    assert df.filter(shared(F.col("x"), F.col("y"))).count() == len(pairs)
    others = spark.createDataFrame([(signed(r.getrandbits(64)), signed(r.getrandbits(64))) for _ in range(2000)], "x long, y long")
    assert others.filter(shared(F.col("x"), F.col("y"))).count() < 0.1 * 2000  # the blocks prune


def test_recall_at_the_limit(spark):
    """Windows whose similarity is just above the limit: candidates come from fingerprints alone, so a few may be missed."""
    ship(spark)
    r = random.Random(4)
    say = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    items = [(i, say(r.randrange(25, 60))) for i in range(40)]
    docs = []
    true = set()
    for d in range(400):
        item, t = r.choice(items)
        t = list(t)
        if d % 2:
            t[r.randrange(3)] = "edited"
        else:
            t = t[1 + d % 3 :] + say(1 + d % 3)
        docs.append((d, " ".join(say(5) + t + say(5))))
        true |= set(brute_leaks(docs[-1:], [(item, " ".join(items[item][1]))]))
    found = {(x["doc_id"], x["item_id"]) for x in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")).collect()}
    assert len(true) > 300 and found <= true and len(found) >= 0.97 * len(true)


def test_clashing_names_and_long_texts(spark):
    ship(spark)
    item = "one two three four five six seven eight"
    names = ("_row", "w", "n_words", "length", "k", "start", "window", "print", "item_id", "similarity", "key")
    long = "filler " * 8_000 + item + " end" * 8_000
    docs = spark.createDataFrame([(1, long, *[5] * len(names)), (2, "clean " * 20, *[6] * len(names)), (1, long, *[5] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    items = spark.createDataFrame([(7, item, 1, "x")], "item_id long, text string, length int, hashes string")
    assert [(x["doc_id"], x["item_id"], x["start"], x["similarity"]) for x in dc.leaks(docs, items).collect()] == [(1, 7, 8_000, 1.0)]
    left = dc.without_leaks(docs, items)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [2]
