import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import toxicity as tx
from sylva.llm.language_model import fold
from sylva.runtime import ship


def corpus(n=1500):
    r = random.Random(2)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "té") for b in ("ban", "dor", "fil", "gan", "hum", "jen", "kol")]
    bad = ["vileword", "badterm", "awfulname"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(5, 120))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "s", "."]))
        docs.append((i, " ".join(words), "x"))
        if r.random() < 0.5:
            labels.append((i, int(toxic)))
    truth = [any(w in t for w in bad) for _, t, _ in docs]
    return docs + [(n, None, "y"), (n + 1, "", "z"), (None, "kaban", "z")], labels + [(None, 1), (3, None)], truth


def test_held_out_accuracy(spark):
    ship(spark)
    docs, labels, truth = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string").repartition(4)
    out = tx.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), fold("doc_id", 5) == 0).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < len(truth)]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


@pytest.mark.parametrize("most", [tx.BROADCAST_IDS, 10])
def test_counts_hold_every_toxic_row(spark, monkeypatch, most):
    ship(spark)
    docs, labels, _ = corpus()
    monkeypatch.setattr(tx, "BROADCAST_IDS", most)
    seen, choose = [], tx.choose
    monkeypatch.setattr(tx, "choose", lambda counts, n, n_toxic, features: seen.append((n, n_toxic)) or choose(counts, n, n_toxic, features))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string").repartition(4)
    how = tx.Fit(positives=20, bucket=400, steps=40)
    assert tx.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False), how).count() == len(docs)
    assert seen == [(len(docs), len({i for i, toxic in labels if i is not None and toxic == 1}))]


def test_without_labels_and_empty(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in tx.toxicity(docs, none, F.lit(False)).collect()] == [0.0]
    assert tx.toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(False)).count() == 0


def test_fit_against_plain_loops():
    """The same risk and steps written out for one text and one weight at a time."""
    r = random.Random(3)
    how = tx.Fit(steps=25, batch=4)
    positive = [np.array(sorted(r.sample(range(6), r.randrange(4))), np.int16) for _ in range(6)]
    unlabelled = [np.array(sorted(r.sample(range(6), r.randrange(4))), np.int16) for _ in range(9)]
    prior, n = 0.4, 6
    w, m, v = [0.0] * 6 + [np.log(prior / (1 - prior))], [0.0] * 7, [0.0] * 7
    below = 0
    for step in range(1, how.steps + 1):
        batches = [[positive[:4], positive[4:]][step % 2], [unlabelled[:4], unlabelled[4:8], unlabelled[8:]][step % 3]]
        margin = [[sum(w[int(f)] for f in x) + w[-1] for x in rows] for rows in batches]
        risk = np.mean([np.log1p(np.exp(z)) for z in margin[1]]) - prior * np.mean([np.log1p(np.exp(z)) for z in margin[0]])
        below += risk < 0

        def slope(k, of, batches=batches, margin=margin):
            out = [0.0] * 7
            for x, z in zip(batches[k], margin[k], strict=True):
                for f in [*map(int, x), 6]:
                    out[f] += of(z) / len(batches[k])
            return out

        sig = lambda z: 1 / (1 + np.exp(-z))
        up, down, own = slope(1, sig), slope(0, sig), slope(0, lambda z: -sig(-z))
        for f in range(7):
            corrected = up[f] - prior * down[f]
            g = (prior * own[f] + corrected if risk >= 0 else -corrected) + (how.decay * w[f] if f < n else 0)
            m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.999 * v[f] + 0.001 * g * g
            w[f] -= how.rate * (m[f] / (1 - 0.9**step)) / (np.sqrt(v[f] / (1 - 0.999**step)) + 1e-8)
    weights, bias = tx.fit(positive, unlabelled, prior, n, how)
    assert np.allclose([*weights, bias], w, atol=1e-9) and 0 < below < how.steps


def test_query_against_brute_force(spark):
    """Features by plain string work, one classifier, and the scores of all rows."""
    import re

    ship(spark)
    docs, labels, _ = corpus(120)
    docs = [d for d in docs if d[0] is not None]
    learned = {i for i, t in labels if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5}
    toxic = {i for i, t in labels if i in learned and t == 1}

    def features(text):
        runs = re.findall(r"[A-Za-z\x80-\U0010ffff]+", text or "")
        found = set()
        for x in runs:
            data = x.encode()
            for part, own in [(data, True)] + [(data[:k], False) for k in tx.STEMS if len(data) >= k]:
                raw = np.frombuffer(part, np.uint8)
                f, _ = tx.features(raw, np.array([0, len(raw)]))
                found.add(int(f[0]) if own else int(tx.features(raw, np.array([0, len(raw)]))[0][1 + [k for k in tx.STEMS if k <= len(part)].index(len(part))]))
        return found

    train = [(i, features(t)) for i, t, _ in docs if zlib.crc32(str(i).encode()) % 5]
    counts = np.zeros((2, 1 << tx.BITS), np.int64)
    for i, found in train:
        for f in found:
            counts[0, f] += 1
            counts[1, f] += i in toxic
    known = {i for i, _ in train}
    chosen = tx.choose(counts, len(train), len(toxic & known), 4096)
    pick = lambda found: np.array(sorted(int(chosen[f]) for f in found if chosen[f] >= 0), np.int16)
    share = len(toxic) / len(learned)
    how = tx.Fit(batch=10**6)  # batches hold all rows, so that their order is of no account
    weights, bias = tx.fit([pick(f) for i, f in train if i in toxic], [pick(f) for _, f in train], share, int(chosen.max()) + 1, how)
    expected = {i: 1 / (1 + np.exp(-(sum(weights[k] for k in pick(features(t))) + bias))) for i, t, _ in docs}
    out = tx.toxicity(spark.createDataFrame(docs, "doc_id long, text string, toxic string").repartition(3), spark.createDataFrame([x for x in labels if x[0] is not None], "doc_id long, toxic int"), fold("doc_id", 5) == 0, how).collect()
    assert all(abs(r["score"] - expected[r["doc_id"]]) < 1e-6 for r in out) and len(out) == len(docs)


def test_repeats_long_texts_and_clashing_names(spark):
    ship(spark)
    docs, labels, _ = corpus(400)
    docs += [docs[7]] * 300 + [(9000, "badterm " * 30_000, "long")]
    df = spark.createDataFrame(docs, "doc_id long, text string, found string").withColumn("key", F.lit(1)).repartition(3)
    how = tx.Fit(bucket=100, steps=20)
    df2 = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x"))
    out = tx.toxicity(df, df2, F.lit(False), how).collect()
    assert len(out) == len(docs) and len({r["score"] for r in out if r["doc_id"] == 7}) == 1 and {r["predicted"] for r in out if r["doc_id"] == 9000} == {1}
