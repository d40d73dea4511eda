"""Bigram scores of whole texts from a log-frequency Bloom filter.

Counts of token pairs are quantised on a log scale: a pair seen c times has level 1 + floor(log_b c). The filter holds
the events (pair, 1) ... (pair, level); a count is read back by probing level after level until one is missing, so it
is never read too low, and too high with a probability that falls with every level. A level stands for the mean
count of its range. The probability of a token after another is

    (c(u, v) + weight * p0(v)) / (c(u) + weight),   p0(v) = (c(v) + 1) / (N + V + 1)

with exact counts c(u), c(v), N and V of single tokens, so an unseen pair falls back to the smoothed unigram. A text
is its words, lower-cased from A to Z, and one end token; before its first token stands a start of text.

The filter is built where the pairs are counted, one region for each range of pair hashes, and has the same bits for
each event at every size of input. It is broadcast to the workers in waves of at most WAVE_BYTES; each wave scores
the pairs whose regions it holds, and the sums of the waves are added. Single-token counts go to blocks of documents
by a join, as they grow with the vocabulary.

Nulls: a null text is empty and has the end token only; a null id counts as the empty string for the choice of
training rows. Repeated rows count each. Texts of any length are scored whole; one that is longer than BLOCK_BYTES is a
block of its own. Extra columns are ignored whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.hashing import U, mix, runs, utf8, words
from sylva.runtime import give_back, materialise, partitions, release

BLOCK_BYTES = 4 << 20
WAVE_BYTES = 96 << 20
#: Blocks of text whose tokens and pairs one range of hashes holds, about. Each block sends a row to each range.
RANGE_BLOCKS = 4
END, START = mix(np.array([1, 2], U))
FIRST, SECOND = (mix(np.array([3, 4], U)) | U(1)).tolist()


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, held out, text) to blocks: token numbers and the block's own list of distinct tokens."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        raw, offsets = utf8(batch.column(2))
        ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        for a, b in runs(offsets, BLOCK_BYTES):
            tokens, counts = [], []
            own = offsets[a : b + 1]
            for c, d in runs(own):
                found, per = words(raw[own[c] : own[d]], own[c : d + 1] - own[c])
                tokens.append(np.insert(found, np.cumsum(per), END))
                counts.append(per + 1)
            distinct, local = np.unique(np.concatenate(tokens), return_inverse=True)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([ids.slice(a, b - a)], names=["id"]))
            parts = [sink.getvalue().to_pybytes(), held[a:b].tobytes(), np.concatenate(counts).astype(np.int32).tobytes(), distinct.tobytes(), pa.compress(local.astype(np.int32).tobytes(), codec="zstd", asbytes=True)]
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], names=["block", *COLUMNS])
            n += 1
    give_back()


COLUMNS = ("ids", "held", "counts", "distinct", "local")
BLOCKS = "block long, ids binary, held binary, counts binary, distinct binary, local binary"


class Block:
    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        view = lambda c, kind: np.frombuffer(batch.column(batch.schema.get_field_index(c))[i].as_buffer(), kind)
        self.block = batch.column(0)[i].as_py()
        self.ids = view("ids", np.uint8)
        self.held = view("held", np.uint8).astype(bool)
        self.counts = view("counts", np.int32).astype(np.int64)
        self.distinct = view("distinct", U)
        self.ends = np.cumsum(self.counts)
        packed = batch.column(batch.schema.get_field_index("local"))[i].as_buffer()
        self.local = np.frombuffer(pa.decompress(packed, 4 * int(self.ends[-1]), codec="zstd"), np.int32)
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def pairs(self) -> np.ndarray:
        """A hash of each token and the one before it."""
        token = self.distinct[self.local]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.ends - self.counts] = START
        return mix(before * U(FIRST) + token * U(SECOND))


def by_range(bits: int, keys: np.ndarray, block: int, counts: np.ndarray, width) -> pa.RecordBatch:
    """Sorted keys with counts as one row for each range; width: the type that keeps the rest of a key."""
    edges = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    used = np.flatnonzero(np.diff(edges))
    rest = keys if width is U else (keys >> U(32 - bits)).astype(np.uint32)
    cut = lambda c: pa.array([c[edges[k] : edges[k + 1]].tobytes() for k in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(np.full(len(used), block), pa.int64()), cut(rest), cut(counts.astype(np.int32))], names=["range", "block", "keys", "counts"])


ASKED = "range long, block long, keys binary, counts binary"


def count_tokens(bits: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch, i)
                learned = np.bincount(b.local[~b.held[b.doc]], minlength=len(b.distinct))
                yield by_range(bits, b.distinct, b.block, learned, U)
        give_back()

    return apply


def count_pairs(bits: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch, i)
                keys, n = np.unique(b.pairs()[~b.held[b.doc]], return_counts=True)
                yield by_range(bits, keys, b.block, n, np.uint32)
        give_back()

    return apply


def add_tokens(table: pa.Table) -> pa.Table:
    """The corpus count of every token of a range, block by block, with the range's N and V."""
    join = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in table[c]]
    keys = join("keys", U)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(join("counts", np.int32)).astype(np.float64), len(found)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    rows = [total[place[e - len(k) : e]].tobytes() for k, e in zip(keys, ends, strict=True)]
    same = lambda x: pa.array(np.full(len(rows), x), pa.int64())
    return pa.table({"block": table["block"], "range": table["range"], "totals": pa.array(rows, pa.binary()), "n": same(total.sum()), "v": same(np.count_nonzero(total))})


def probe(keys: np.ndarray, level: int, region_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the region, four bits in it) of the events (key, level)."""
    h = mix(keys.astype(U) * U(SECOND) + U(level))
    mask = np.zeros(len(h), U)
    for shift in (0, 6, 12, 18):
        mask |= U(1) << ((h >> U(shift)) & U(63))
    return ((h >> U(32)) * U(region_words) >> U(32)).astype(np.int64), mask


def build(base: float, bits_per_event: int):
    """The filter's region of one range of pairs."""

    def apply(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]])
        found, place = np.unique(join("keys", np.uint32), return_inverse=True)
        total = np.bincount(place, join("counts", np.int32).astype(np.float64), len(found))
        level = levels(total, base)
        region = np.zeros(max(1, -(-int(level.sum()) * bits_per_event // 64)), U)
        for j in range(1, int(level.max()) + 1):
            word, mask = probe(found[level >= j], j, len(region))
            np.bitwise_or.at(region, word, mask)
        return pa.table({"range": pa.array([table["range"][0].as_py()], pa.int64()), "words": pa.array([len(region)], pa.int64()), "region": pa.array([region.tobytes()], pa.binary())})

    return apply


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def mean_count(level: np.ndarray, base: float) -> np.ndarray:
    """What a level stands for: the mean of the whole counts that have it."""
    low = np.ceil(base ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(base ** level.astype(float) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def read_levels(keys: np.ndarray, part: np.ndarray, starts: np.ndarray, sizes: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Level of each key by repeated probes of the regions at starts, of sizes words."""
    level, live, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while len(live):
        h = mix(keys[live].astype(U) * U(SECOND) + U(j))
        mask = np.zeros(len(h), U)
        for shift in (0, 6, 12, 18):
            mask |= U(1) << ((h >> U(shift)) & U(63))
        word = ((h >> U(32)) * sizes[part[live]].astype(U) >> U(32)).astype(np.int64) + starts[part[live]]
        live = live[(filter_[word] & mask) == mask]
        level[live] = j
        j += 1
    return level


def score_wave(bits: int, wave: tuple[int, int], held, facts: dict, first: bool, base: float, weight: float):
    """Sums of the log10 probabilities of the tokens of each document whose pair is in this wave's ranges."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, data = held.value
        sizes = np.asarray(sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        filter_ = np.frombuffer(data, U)
        for batch in batches:
            replies = batch.column(batch.schema.get_field_index("replies"))
            for i in range(batch.num_rows):
                b = Block(batch, i)
                got = sorted(replies[i].as_py(), key=lambda r: r["range"])
                total = np.concatenate([np.frombuffer(r["totals"], np.int64) for r in got]).astype(np.float64)
                if len(total) != len(b.distinct):
                    raise ValueError("the tokens of a block changed between two readings")
                seen = total[b.local]
                before = np.empty_like(seen)
                before[1:] = seen[:-1]
                before[b.ends - b.counts] = facts["docs"]
                pair = b.pairs()
                part = (pair >> U(64 - bits)).astype(np.int64)
                mine = np.flatnonzero((part >= wave[0]) & (part < wave[1]))
                keys = (pair[mine] >> U(32 - bits)).astype(np.uint32)
                own, prior = seen[mine], before[mine]
                c = np.minimum(mean_count(read_levels(keys, part[mine] - wave[0], starts, sizes, filter_), base), np.minimum(own, prior))
                p0 = (own + 1) / (facts["n"] + facts["v"] + 1)
                score = np.bincount(b.doc[mine], np.log10((c + weight * p0) / (prior + weight)), len(b.counts))
                ids = pa.ipc.open_stream(pa.py_buffer(b.ids.tobytes())).read_next_batch().column(0)
                known, plain = np.zeros(len(b.counts), np.int64), np.zeros(len(b.counts))
                if first:
                    known = np.bincount(b.doc, seen > 0, len(b.counts)).astype(np.int64)
                    plain = np.bincount(b.doc, np.log10((seen + 1) / (facts["n"] + facts["v"] + 1)), len(b.counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.counts), b.block)), pa.array(np.arange(len(b.counts))), ids, pa.array(b.held), pa.array(b.counts), pa.array(known), pa.array(plain), pa.array(score)],
                    names=["_block", "_row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )
        give_back()

    return apply


def score_texts(docs: DataFrame, held_out: Column, text: str = "text", id_column: str = "doc_id", base: float = 1.5, weight: float = 30.0, bits_per_event: int = 10, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Score every row of docs by a model of the rows that are not held out.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). base: of the logarithm of counts;
    weight: how many observations the unigram counts for after each token.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out.alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = materialise(rows.mapInArrow(encode, BLOCKS), "encoded")
    n_blocks = blocks.count()
    bits = max(1, (max(partitions(spark), -(-n_blocks // RANGE_BLOCKS), 2) - 1).bit_length())
    totals = materialise(blocks.mapInArrow(count_tokens(bits), ASKED).groupBy("range").applyInArrow(add_tokens, "block long, range long, totals binary, n long, v long"), "totals")
    facts = totals.groupBy("range").agg(F.max("n").alias("n"), F.max("v").alias("v")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first().asDict()
    facts["docs"] = rows.filter(~F.col("held")).count()
    regions = materialise(blocks.mapInArrow(count_pairs(bits), ASKED).groupBy("range").applyInArrow(build(base, bits_per_event), "range long, words long, region binary"), "filter")
    sizes = {r["range"]: r["words"] for r in regions.select("range", "words").toLocalIterator()}
    replies = totals.groupBy("block").agg(F.collect_list(F.struct("range", "totals")).alias("replies"))
    ready = blocks.join(replies, "block")
    waves = plan_waves(sizes, 1 << bits, wave_bytes // 8)
    if len(waves) > 1:
        ready = materialise(ready, "ready")
    parts = []
    for i, (a, b) in enumerate(waves):
        words_of = np.array([sizes.get(k, 1) for k in range(a, b)], np.int64)
        place = 8 * (np.cumsum(words_of) - words_of)
        filter_ = bytearray(8 * int(words_of.sum()))  # filled row by row, so that the wave is held once
        for r in regions.filter(F.col("range").between(a, b - 1)).toLocalIterator():
            first = int(place[r["range"] - a])
            filter_[first : first + len(r["region"])] = r["region"]
        shared = spark.sparkContext.broadcast((words_of.tolist(), filter_))
        del filter_
        one = ready.mapInArrow(score_wave(bits, (a, b), shared, facts, i == 0, base, weight), f"_block long, _row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        parts.append(materialise(one, f"wave-{i}"))
        shared.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        keys = ("_block", "_row", "doc_id", "held_out", "n_tokens")
        out = out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    for used in (blocks, totals, regions):
        release(used)
    return out.select(F.col("doc_id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(facts["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def plan_waves(sizes: dict[int, int], ranges: int, most: int) -> list[tuple[int, int]]:
    """Runs of ranges whose regions have at most that many words together; a region that is larger is a run of its own."""
    out, first, held = [], 0, 0
    for k in range(ranges):
        n = sizes.get(k, 1)
        if held and held + n > most:
            out.append((first, k))
            first, held = k, 0
        held += n
    return [*out, (first, ranges)]
