import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import repeats
from sylva.llm.suffix_array import common_prefixes, merge_shards, suffix_array
from sylva.runtime import ship

SCHEMA = "doc_id long, text string, n_bytes int, _text string"


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            g = b[p : p + 50]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, docs=120):
    r = random.Random(seed)
    syllables = ["the ", "of ", "an", "er", "é", "tion ", "la", "ñ", "ing ", "\n"]
    say = lambda n: "".join(r.choice(syllables) for _ in range(n))
    shared, texts = [say(k) for k in (20, 40, 70, 200)], []
    for _ in range(docs):
        kind = r.random()
        if kind < 0.2 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.6:
            texts.append(say(r.randrange(60)) + r.choice(shared) + say(r.randrange(60)) + r.choice(shared))
        elif kind < 0.7 and texts:
            t = r.choice(texts) or ""
            cut = r.randrange(len(t) + 1)
            texts.append(t[:cut] + say(2) + t[cut:])
        else:
            texts.append(r.choice(["", None, "a" * r.randrange(200), say(r.randrange(100)), "ab" * 80]))
    ids = list(range(docs))
    r.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [rows[3], (None, texts[1]), (None, None)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes_out", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("spread,block", [(2048, 8 << 20), (1, 2000), (4, 500)])
def test_against_every_string(spark, spread, block):
    ship(spark)
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(5)
        out = repeats.remove_repeats(df, block_bytes=block, spread=spread).withColumnRenamed("n_bytes", "n_bytes_out")
        assert rows_of(out) == brute(rows)


def test_ends_of_shared_passages_in_large_portions(spark):
    ship(spark)
    r = random.Random(0)
    say = lambda n: "".join(r.choice("abc") for _ in range(n))
    shared = [say(r.randrange(57, 90)) for _ in range(200)]
    rows = [(i, "".join(r.choice(shared) + say(r.randrange(1, 30)) for _ in range(20))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = repeats.remove_repeats(df).withColumnRenamed("n_bytes", "n_bytes_out")
    assert rows_of(out) == brute(rows)


def test_empty_and_extra_columns(spark):
    ship(spark)
    empty = spark.createDataFrame([], SCHEMA)
    assert repeats.remove_repeats(empty).count() == 0
    text = "some words that are long enough to be found as one string of fifty bytes"
    df = spark.createDataFrame([(1, text, "x"), (2, text + " more", "y")], "doc_id long, text string, _text string")
    df = df.withColumns({c: df["doc_id"] for c in ("n_bytes", "n_removed", "kept_sha256", "kept_text", "block", "ids", "_id", "_first")})
    out = {r["doc_id"]: r for r in repeats.remove_repeats(df, kept_text=True).collect()}
    assert out[1]["kept_text"] == text and out[2]["kept_text"] == " more" and out[2]["_text"] == "y"
    assert (out[2]["n_bytes"], out[2]["n_removed"], out[2]["kept_sha256"], out[2]["_id"], out[2]["block"]) == (len(text) + 5, len(text), 2, 2, 2)


def test_pieces_of_one_hash_are_told_apart():
    r = random.Random(6)
    pieces = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 4))) for _ in range(200)]
    sizes = np.array([len(p) for p in pieces])
    text, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes
    for content in (np.zeros(200, np.uint64), (sizes % 2).astype(np.uint64)):
        sample, kind = repeats.by_bytes(content, text, starts, sizes)
        assert all(pieces[sample[kind[i]]] == p for i, p in enumerate(pieces)) and len(set(kind.tolist())) == len(set(pieces))


def test_strings_are_merged_by_their_bytes(spark):
    """Fingerprints that collide decide nothing: shards are merged by whole strings, which may end in zero bytes."""
    ship(spark)
    r = random.Random(9)
    shared = ["".join(r.choice("ab\x00") for _ in range(60)) + "\x00" * 5 for _ in range(6)]
    rows = [(i, "".join(r.choice(shared) + "".join(r.choice("cd") for _ in range(9)) for _ in range(4))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = repeats.remove_repeats(df, spread=1).withColumnRenamed("n_bytes", "n_bytes_out")
    assert rows_of(out) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 3 for x in b)))
def test_suffix_array(data):
    a = np.frombuffer(data, np.uint8)
    sa = suffix_array(a)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    lcp = common_prefixes(a, sa, 50, lanes=7)
    for k in range(1, len(data)):
        x, y = data[sa[k - 1] :], data[sa[k] :]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert lcp[k] == min(n, 50)


def test_depth_groups():
    a = np.frombuffer(b"abcabcabcabcabcabcabcabc" * 4, np.uint8)
    sa = suffix_array(a, 8)
    prefixes = [bytes(a[i : i + 8]) for i in sa]
    assert prefixes == sorted(prefixes)


def test_merge_shards():
    keys, least = merge_shards([(np.array([1, 5], np.uint64), np.array([7, 2])), (np.array([5, 9], np.uint64), np.array([1, 4]))])
    assert keys.tolist() == [1, 5, 9] and least.tolist() == [7, 1, 4]


def test_owners_fill_ranges_evenly():
    """Smallest hashes of windows are small numbers: unmixed, a quarter of them and more stand in the first of 32 ranges."""
    raw = np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8)
    found = np.unique(repeats.owners(raw, np.array([0, len(raw)]))[0])
    per = np.bincount((found >> np.uint64(59)).astype(np.int64), minlength=32)
    assert len(found) > 5000 and per.max() < 1.5 * per.mean()
