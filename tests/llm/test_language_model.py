import inspect
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import language_model as lm
from sylva.runtime import ship


def brute(rows, base=1.5, weight=30.0):
    toks = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n end"]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c, pairs, docs = Counter(), Counter(), 0
    for (_, t), h in zip(rows, held):
        if not h:
            c.update(toks(t))
            pairs.update(zip(["\n start", *toks(t)], toks(t)))
            docs += 1
    n, v, out = sum(c.values()), len(c), []
    for (i, t), h in zip(rows, held):
        plain = score = 0.0
        for u, w in zip(["\n start", *toks(t)], toks(t)):
            before = docs if u == "\n start" else c[u]
            k = pairs[u, w]
            if k:
                level = lm.levels(np.array([k]), base)
                k = min(float(lm.mean_count(level, base)[0]), before, c[w])
            p0 = (c[w] + 1) / (n + v + 1)
            plain += math.log10(p0)
            score += math.log10((k + weight * p0) / (before + weight))
        out.append((i, h, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(plain, 6), round(score, 6)))
    return sorted(out, key=str)


def corpus(n=80):
    r = random.Random(5)
    vocabulary = ["the", "The", "of", "é", "ñu", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(r.choice(vocabulary[: r.choice([4, 66])]) for _ in range(r.randrange(80)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, "the of the"), rows[0]]


@pytest.mark.parametrize("wave", [1 << 26, 256])
def test_against_exact_counts(spark, wave):
    ship(spark)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lm.score_texts(df, lm.fold("doc_id", 7) == 2, bits_per_event=200, wave_bytes=wave)
    got = sorted(((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in out.collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    ship(spark)
    df = spark.createDataFrame([], "doc_id long, text string, score double, _row int")
    assert lm.score_texts(df, F.lit(False)).count() == 0


def test_filter_never_reads_low_and_seldom_high():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 32, 20000).astype(np.uint32))
    counts = np.minimum(r.zipf(1.7, len(keys)), 10**6).astype(float)
    level = lm.levels(counts, 1.5)
    region = np.zeros(-(-int(level.sum()) * 10 // 64), np.uint64)
    for j in range(1, level.max() + 1):
        word, mask = lm.probe(keys[level >= j], j, len(region))
        np.bitwise_or.at(region, word, mask)
    read = lm.read_levels(keys, np.zeros(len(keys), np.int64), np.zeros(1, np.int64), np.array([len(region)]), region)
    assert (read >= level).all() and (read > level).mean() < 0.06
    other = np.setdiff1d(r.integers(0, 1 << 32, 20000).astype(np.uint32), keys)
    unseen = lm.read_levels(other, np.zeros(len(other), np.int64), np.zeros(1, np.int64), np.array([len(region)]), region)
    assert (unseen > 0).mean() < 0.06


def test_false_membership_at_the_production_value():
    bits = inspect.signature(lm.score_texts).parameters["bits_per_event"].default
    r = np.random.default_rng(4)
    keys = r.permutation(1 << 20)[:200_000].astype(np.uint32)
    region = np.zeros(-(-100_000 * bits // 64), np.uint64)
    word, mask = lm.probe(keys[:100_000], 1, len(region))
    np.bitwise_or.at(region, word, mask)
    unseen = lm.read_levels(keys[100_000:], np.zeros(100_000, np.int64), np.zeros(1, np.int64), np.array([len(region)]), region)
    assert (unseen > 0).mean() < 0.025


def test_long_texts_and_clashing_names(spark):
    ship(spark)
    rows = [*corpus(20)[:-1], (500, "the of the " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    names = ("held", "held_out", "block", "range", "ids", "n_tokens", "score", "_row", "train_tokens", "replies")
    out = lm.score_texts(df.withColumns({n: F.lit(1) for n in names}), lm.fold("doc_id", 7) == 2, bits_per_event=200)
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 4), round(r["score"], 4)) for r in out.collect()), key=str) == [(*r[:5], round(r[5], 4), round(r[6], 4)) for r in brute(rows)]
