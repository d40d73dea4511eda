import random
import re

import numpy as np
import pytest

from sylva.llm import jaccard_join as jj
from sylva.llm.components import components
from sylva.runtime import ship


def sets_of(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=90):
    sets = {i: sets_of(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(sets_of(t)), find(i) if i is not None else None) for i, t in rows), key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "the", "of"]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    common, texts = [say(60), say(30)], []
    for _ in range(n):
        kind = r.random()
        if kind < 0.5 and texts:
            w = (r.choice(texts) or "").split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" \t".join(w))
        elif kind < 0.8:
            texts.append(say(r.randrange(40)) + " " + r.choice(common) + " " + r.choice(common))
        else:
            texts.append(r.choice(["", None, " \n", "one", "ONE", "two words", say(200), say(20)]))
    ids = list(range(n))
    r.shuffle(ids)
    return list(zip(ids, texts)) + [(None, "null id"), (None, None)]


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    ship(spark)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(jj.jaccard_components(df)) == brute(rows)


def test_empty(spark):
    ship(spark)
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string, _id int, n int")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_signatures_are_shared_whatever_the_classes(seed):
    r = np.random.default_rng(seed)
    for _ in range(300):
        n = int(r.integers(1, 400))
        tokens = np.unique(r.integers(0, 1 << 62, n + 60).astype(np.uint64))
        low = r.random(3) * 1
        cls = lambda t: np.searchsorted(np.sort(low) * 9, (t % np.uint64(1000)).astype(float) / 111).clip(0, 2).astype(np.uint8)  # noqa: E731,B023
        base, extra = tokens[r.permutation(len(tokens))][:n], tokens[:60]
        best = None
        for miss in range(0, 50):
            x = np.sort(base)
            y = np.unique(np.concatenate((r.permutation(base)[miss // 2 :], extra[: miss - miss // 2])))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 90 * (len(x) + len(y) - common):
                best = (x, y)
        x, y = best
        assert len(np.intersect1d(jj.signatures(x, cls(x), 90), jj.signatures(y, cls(y), 90)))


def test_components_of_a_long_path_and_a_star(spark):
    ship(spark)
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 200)]
    r = {x["node"]: x["root"] for x in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert all(r[i] == 0 for i in range(61)) and all(r[i] == 100 for i in range(100, 200))


def test_left_over_pairs_miss_none():
    import pyarrow as pa

    from sylva.llm.hashing import U

    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 62, 90).astype(np.uint64) << U(2))
    sets = [np.unique(np.concatenate((r.permutation(base)[: r.integers(70, 91)], r.integers(0, 1 << 62, r.integers(0, 9)).astype(np.uint64) << U(2)))) for _ in range(60)]
    rows = []
    for i, s in enumerate(sets):
        bits = min(5 if i % 2 else 4, max(1, (len(s) // 4).bit_length()))
        counts = np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8)
        rows.append((i, i // 2, len(s), counts.tobytes() if i % 7 else None))
    table = pa.table({n: pa.array([x[k] for x in rows]) for k, n in enumerate(("b", "root", "n", "profile"))})
    got = jj.left_over(90)(table)
    pairs = set(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    assert len(pairs) == got.num_rows
    for a in range(60):
        for b in range(a + 1, 60):
            common = len(np.intersect1d(sets[a], sets[b]))
            if a // 2 != b // 2 and 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                assert (a, b) in pairs


def test_long_texts_and_clashing_names(spark):
    from pyspark.sql import functions as F

    ship(spark)
    long = [f"w{i}" for i in range(40_000)]
    rows = [(5, " ".join(long)), (3, " ".join([*long[:-50], "other", "end"])), (9, " ".join(long[::2])), (1, None), (2, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    names = ("set", "root", "n", "_first", "_id", "_lead", "_own", "_sha", "profile", "kind", "key", "n_shingles", "component_id", "node")
    out = jj.jaccard_components(df.withColumns({n: F.lit(1) for n in names})).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} == {(5, 39_998, 3), (3, 39_950, 3), (9, 19_998, 9), (1, 0, 1), (2, 1, 2)}


def test_a_passage_in_every_document_and_many_near_copies(spark):
    """All share one passage, and half are near copies of one text: links come from stars, and few pairs are compared."""
    ship(spark)
    r = np.random.default_rng(8)
    say = lambda n: [f"w{k}" for k in r.integers(0, 5000, n)]
    passage, text = say(60), say(200)
    rows = [(i, " ".join(text[:-1] + [f"own{i}"])) for i in range(600)] + [(600 + i, " ".join(say(40) + passage + say(40))) for i in range(600)]
    out = {x["doc_id"]: x["component_id"] for x in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(out[i] == 0 for i in range(600)) and all(out[600 + i] == 600 + i for i in range(600))


def meetings(sets, percent=80):
    """Rows of meet() for sets {signature: [(doc, size)]}."""
    import pyarrow as pa

    sig, doc, size = zip(*[(s, d, n) for s, rows in sets.items() for d, n in rows], strict=True)
    cut = lambda x, t: pa.array([np.array(x, t).tobytes()], pa.binary())
    found = jj.meet(percent)(pa.table({"a": cut(sig, np.uint32), "b": cut(doc, np.int64), "c": cut(size, np.int32)})).to_pydict()
    rows = list(zip(*(found[c] for c in ("kind", "a", "b", "n")), strict=True))
    return {(a, b) for kind, a, b, _ in rows if kind == 0}, [(b, n) for kind, _, b, n in rows if kind == 1]


def test_sets_are_parted_where_no_sizes_are_near():
    """Documents that share a signature by chance but can't be similar are neither links to try nor members."""
    assert meetings({7: [(1, 100), (2, 10), (3, 1000)]}) == (set(), [])
    assert meetings({7: [(9, 100), (2, 10), (3, 90), (4, 12)]}) == ({(3, 9), (2, 4)}, [])
    links, members = meetings({7: [(9, 100), (2, 10), (3, 90), (4, 82), (5, 12)]})
    assert links == {(3, 4), (3, 9), (2, 5)} and sorted(members) == [(3, 90), (4, 82), (9, 100)]


def test_ranges_follow_the_signatures():
    """Documents that share many signatures met once in each of as many ranges as the session had partitions."""
    assert jj.bits_for(1000, 80) == 1 and jj.bits_for(0, 90) == 1
    assert jj.bits_for(10**9, 80) == 10


def test_packed_profiles_are_whole():
    import pyarrow as pa

    counts = np.random.default_rng(4).poisson(0.4, 1024).astype(np.uint8)
    data = jj.packed(counts, 10)
    assert len(data) < 400 and (jj.unpacked(pa.scalar(data, pa.binary())) == counts).all()


def overlapping(seed, n=60, least=3):
    """Signatures of near copies: each is in most of them, and some are in a few documents."""
    r = np.random.default_rng(seed)
    return {s: [(int(d), 100 + int(d) % 5) for d in sorted(r.choice(n, r.integers(least, n) if s % 3 else least, replace=False))] for s in range(40)}


def test_documents_of_many_sets_meet_once_in_a_range():
    """A document was a row for each set that it was in: rows grew with a group's size times its signatures."""
    sets = overlapping(3)
    links, members = meetings(sets)
    assert members == sorted({x for rows in sets.values() for x in rows})
    assert links >= {(rows[0][0], d) for rows in sets.values() for d, _ in rows[1:]}


@pytest.mark.parametrize("seed", range(3))
def test_open_sets_are_gathered_and_lose_no_pair(seed):
    import pyarrow as pa

    sets = overlapping(seed)
    root = [d // 30 * 30 if d % 7 else d for d in range(60)]
    sig, doc, size = zip(*[(s, d, n) for s, rows in sets.items() for d, n in rows], strict=True)
    cut = lambda x, t: pa.array([np.array(x[:200], t).tobytes(), np.array(x[200:], t).tobytes()], pa.binary())
    table = pa.table({"a": cut(sig, np.uint32), "b": cut(doc, np.int64), "c": cut(size, np.int32), "d": cut([root[d] for d in doc], np.int64)})
    got, found = jj.still_apart(80)(table).to_pydict(), {}
    for s, d, n, r in zip(*(got[c] for c in ("set", "b", "n", "root")), strict=True):
        assert n == 100 + d % 5 and r == root[d] and d not in found.setdefault(s, set())
        found[s].add(d)
    alike = [{d for d, _ in rows} for rows in sets.values() if len({root[d] for d, _ in rows}) > 1]
    assert alike and all(any(one <= whole for whole in found.values()) for one in alike)
    assert len(got["b"]) < 0.6 * sum(map(len, alike))
    same = table.set_column(3, "d", cut([0] * len(doc), np.int64))
    assert jj.still_apart(80)(same).num_rows == 0


def tables(batch, bits, percent=80, k=3, rooted=False):
    """The tables of all ranges for a batch (doc_id, text[, root]) whose shingles are all rare."""
    import pyarrow as pa

    class Rare:
        value = np.zeros(1 << jj.SKETCH_BITS, np.uint8)

    rows = pa.Table.from_batches(list(jj.index(k, percent, bits, Rare, rooted)([batch])))
    key, kind = (rows[c].to_numpy() for c in ("key", "kind"))
    return [rows.filter(pa.array((key == x) & (kind == 1))) for x in np.unique(key[kind == 1])]


def copies_of_texts(seed):
    """Texts in two to six versions each, from hardly changed to half new, and a passage in some of them."""
    import pyarrow as pa

    r = np.random.default_rng(seed)
    say = lambda n: [f"w{x}" for x in r.integers(0, 50_000, n)]
    passage, texts = say(12), []
    for group in range(60):
        base = say(int(r.integers(60, 200)))
        for _ in range(2 if group % 3 else int(r.integers(3, 7))):
            words, cut = list(base), int(len(base) * r.choice([0, 0.05, 0.2, 0.5]))
            words[:cut] = say(cut)
            texts.append(" ".join(words + (passage if r.random() < 0.2 else [])))
    ids = r.permutation(len(texts))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array(ids // 40 * 40)], names=["doc_id", "text", "root"])


@pytest.mark.parametrize("seed", range(3))
def test_documents_that_share_much_meet_in_few_of_many_ranges(seed):
    """Near copies met once in each range where they share a signature: rows grew with the number of ranges as well as with the documents."""
    batch = copies_of_texts(seed)
    few, many = ([jj.meet(80)(t) for t in tables(batch, bits)] for bits in (1, 14))
    assert sum(t.num_rows for t in many) < 4 * sum(t.num_rows for t in few)
    links, members = set(), set()
    for t in many:
        for kind, a, b in zip(*(t[c].to_pylist() for c in ("kind", "a", "b")), strict=True):
            (members if kind else links).add(b if kind else (a, b))
    size, shared, threes = {}, {}, set()
    for t in tables(batch, 14):
        for s, d, n in zip(*(np.concatenate([np.frombuffer(x.as_buffer(), y) for x in t[c]]).tolist() for c, y in (("a", np.uint32), ("b", np.int64), ("c", np.int32))), strict=True):
            size[d] = n
            shared.setdefault((t["key"][0].as_py(), s), []).append(d)
    near = lambda a, b: 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b])
    for docs in shared.values():
        for a in docs:
            if sum(near(a, b) for b in docs) > 2:
                threes.add(a)
    assert threes <= members
    for docs in shared.values():
        assert all((a, b) in links or {a, b} <= members for a in docs for b in docs if a < b and near(a, b))


@pytest.mark.parametrize("seed", range(3))
def test_open_sets_of_many_ranges_lose_no_pair(seed):
    batch = copies_of_texts(seed)
    root, found, held = dict(zip(batch["doc_id"].to_pylist(), batch["root"].to_pylist(), strict=True)), {}, 0
    for t in tables(batch, 14, rooted=True):
        got = jj.still_apart(80)(t)
        held += got.num_rows
        for s, d in zip(got["set"].to_pylist(), got["b"].to_pylist(), strict=True):
            found.setdefault(s, set()).add(d)
    plain = [t.drop_columns(["marks"]) for t in tables(batch, 14, rooted=True)]
    before, wanted = 0, set()
    for t in plain:
        group, doc, *_ = jj.common_sets(t, 80)
        before += jj.still_apart(80)(t).num_rows
        for g in np.unique(group):
            docs = doc[group == g].tolist()
            if len(docs) > 2:
                wanted |= {(a, b) for a in docs for b in docs if a < b and root[a] != root[b]}
    got = {(a, b) for docs in found.values() for a in docs for b in docs if a < b}
    assert wanted and wanted <= got and 2 * held < before
