"""Removal of repeated byte strings across documents (suffix-array dedup).

A byte is removed if a string of `match` bytes that covers it also starts in a document with a smaller id. Strings
are judged on the input. The work is exact and goes in four steps, none of which gathers an unbounded group:

1. Exact copies are found by a digest of the whole text; all but the smallest id go as a whole.
2. The other texts are packed into compressed blocks. Every string of `match` bytes has an owner: the smallest hash among the
   24-byte grams in it, mixed once more. Equal strings have equal owners, so strings whose owner stands once in the corpus are unique.
   Owners are counted, once per block each, to find those that stand twice or more.
3. Only the pieces of text with a shared owner are sent to the shard of that owner. Equal pieces are collapsed; the
   rest gets a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai. Runs with a common prefix
   of `match` bytes are one string, whose smallest document keeps it.
4. Owners that stand very often are spread over several shards by the content of the piece. What such a shard can't
   decide alone (the first of each string in it) is merged across shards by binary search in the sorted strings.

Hashes only bring equal strings together; whatever decides on a removal compares bytes: suffixes by their order and
common prefixes, equal pieces byte by byte, strings of several shards as a whole.

The removed ranges go back to the blocks, which cut them out. Ties: rows that share an id never remove from each
other. Nulls: a null text is empty; a row with a null id is left whole and is no source. A text of any length is a block
of its own at most. Extra columns are carried along whatever their names, but for those with the name of a result, which
the result replaces. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.llm.copies import mark_copies
from sylva.llm.hashing import EXACT, U, mix, prefix_sums, range_hash, runs, utf8
from sylva.llm.suffix_array import common_prefixes, merge_shards, smallest, suffix_array
from sylva.runtime import give_back, materialise, partitions, release, relieve

MATCH, GRAM = 50, 24
#: Bytes of text in a block at most, but for a document that is longer.
BLOCK_BYTES = 2 << 20
#: Blocks of text whose owners one range of hashes holds, about.
RANGE_BLOCKS = 8
#: Pieces of one owner in one shard, about; owners with more are spread.
SPREAD = 2048
SHIFT = 24
#: Bytes in one suffix array, about.
SORTED_BYTES = 1 << 19


def owners(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last): runs of starts of MATCH-byte strings that lie within a document and have the same owner."""
    window = MATCH - GRAM + 1
    parts = []
    for a, b in runs(offsets):
        at, text = offsets[a], raw[offsets[a] : offsets[b]]
        n = len(text) - MATCH + 1
        if n < 1:
            continue
        sums = prefix_sums(text, EXACT)
        first = np.arange(len(text) - GRAM + 1)
        low = mix(range_hash(sums, first, first + GRAM))
        width = 1
        while 2 * width <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[window - width :][:n])
        inside = np.zeros(n + 1, np.int8)
        starts, ends = offsets[a:b] - at, offsets[a + 1 : b + 1] - at
        long = ends - starts >= MATCH
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - MATCH + 1, -1)
        valid = np.cumsum(inside[:n]) > 0
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
        new[starts[starts < n]] = True
        head = np.flatnonzero(new & valid)
        if len(head):
            cut = np.flatnonzero(new | ~valid)
            stop = np.append(cut, n)[np.searchsorted(cut, head) + 1]
            # Smallest hashes are small; mixed again they fill ranges and shards evenly.
            parts.append((mix(low[head]), head + at, stop - 1 + at))
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def gather(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, raw.dtype)
    return raw[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


def pack(block_bytes: int):
    """Batches of (id, other columns..., text) to block rows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = utf8(batch.column(batch.num_columns - 1))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], names=[f"c{i}" for i in range(batch.num_columns - 1)])
            for a, b in runs(offsets, block_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_batch(rest.slice(a, b - a))
                row = [[task << 32 | n], [ids[a:b].tobytes()], [(offsets[a : b + 1] - offsets[a]).tobytes()], [pa.compress(raw[offsets[a] : offsets[b]].tobytes(), codec="zstd", asbytes=True)], [sink.getvalue().to_pybytes()]]
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["block", "ids", "offsets", "raw", "rest"])
        give_back()

    return apply


def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    for i in range(batch.num_rows):
        view = lambda c, kind, i=i: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
        offsets = view(2, np.int64)
        raw = np.frombuffer(pa.decompress(batch.column(3)[i].as_buffer(), int(offsets[-1]), codec="zstd"), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        yield batch.column(0)[i].as_py(), view(1, np.int64), offsets, raw, i


def bits_for(spark, blocks: int) -> int:
    """log2 of the number of owner ranges: one for each RANGE_BLOCKS blocks at least, so that a range holds no more than these do.

    Each block sends a row to each range, so the rows grow with blocks * blocks / RANGE_BLOCKS, as those of any shuffle do.
    """
    return max(1, (max(partitions(spark), -(-blocks // RANGE_BLOCKS), 2) - 1).bit_length())


def ask(bits: int):
    """Distinct owners of each block, cut into ranges."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, offsets, raw, _ in unpack(batch):
                found, n = np.unique(owners(raw, offsets)[0], return_counts=True)
                yield slices(bits, found, block, [(found >> U(32 - bits)).astype(np.uint32), np.minimum(n, 255).astype(np.uint8)])
        give_back()

    return apply


def slices(bits: int, found: np.ndarray, block: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    edges = np.searchsorted(found >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    used = np.flatnonzero(np.diff(edges))
    cut = lambda c: pa.array([c[edges[k] : edges[k + 1]].tobytes() for k in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(np.full(len(used), block), pa.int64()), *map(cut, columns)], names=["range", "block", "keys", "counts"])


def answer(spread: int):
    """For each owner of each block of a range: 0 if it stands once, else 1 and more for owners to spread."""
    return lambda table: codes_of(table, spread)


def codes_of(table: pa.Table, spread: int) -> pa.Table:
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["keys"]]
    counts = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["counts"]]
    everything = np.concatenate(keys)
    found, place = np.unique(everything, return_inverse=True)
    total = np.bincount(place, np.concatenate(counts).astype(np.float64), len(found))
    code = np.where(total < 2, 0, 1 + np.maximum(0, np.ceil(np.log2(np.maximum(total, 1) / spread)))).astype(np.uint8)[place]
    ends = np.cumsum([len(k) for k in keys])
    parts = [code[e - len(k) : e].tobytes() for k, e in zip(keys, ends, strict=True)]
    return pa.table({"block": table["block"], "range": table["range"], "codes": pa.array(parts, pa.binary())})


def pieces(bits: int):
    """Pieces of text with a shared owner, by shard."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = batch.column(5).to_pylist()
            for block, ids, offsets, raw, i in unpack(batch):
                own, first, last = owners(raw, offsets)
                found, place = np.unique(own, return_inverse=True)
                reply = sorted(replies[i] or [], key=lambda r: r["range"])
                code = np.frombuffer(b"".join(r["codes"] for r in reply), np.uint8)
                if len(code) != len(found):
                    raise ValueError("the owners of a block changed between two readings")
                code = code[place]
                keep = code > 0
                own, first, last, code = own[keep], first[keep], last[keep], code[keep]
                if not len(own):
                    continue
                doc = ids[np.searchsorted(offsets, first, "right") - 1]
                size = last - first + MATCH
                salt = np.zeros(len(own), np.int64)
                hot = np.flatnonzero(code > 1)
                for j in hot:  # spread by content
                    digest = hashlib.blake2b(raw[first[j] : last[j] + MATCH].tobytes(), digest_size=4).digest()
                    salt[j] = 1 + int.from_bytes(digest, "big") % (1 << min(int(code[j]) - 1, SHIFT - 1))
                shard = (own >> U(64 - bits)).astype(np.int64) << SHIFT | salt
                order = np.argsort(shard, kind="stable")
                shard, own, first, size, doc = (x[order] for x in (shard, own, first, size, doc))
                heads = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
                edges = np.append(heads, len(shard))
                own = (own >> U(32 - bits)).astype(np.uint32)
                cut = lambda c, e=edges: pa.array([c[e[k] : e[k + 1]].tobytes() for k in range(len(e) - 1)], pa.binary())
                text = pa.array([pa.compress(gather(raw, first[a:b], size[a:b]).tobytes(), codec="zstd", asbytes=True) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[heads], pa.int64()), pa.array(np.full(len(heads), block), pa.int64()), cut(own), cut(doc), cut(first.astype(np.int32)), cut(size.astype(np.int32)), text],
                    names=["shard", "block", "owners", "docs", "firsts", "sizes", "text"],
                )
        give_back()

    return apply


def portions(owner: np.ndarray, length: np.ndarray) -> Iterator[slice]:
    """Slices of sorted owners with about SORTED_BYTES each; an owner is never cut."""
    if not len(owner):
        return
    heads = np.append(np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))), len(owner))
    ends = np.append(0, np.cumsum(length))[heads]
    at = 0
    while at < len(heads) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SORTED_BYTES, "right")) - 1)
        yield slice(heads[at], heads[to])
        at = to


FOUND = "kind int, key long, a binary, b binary, c binary, d binary"
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), *((x, pa.binary()) for x in "abcd")])
#: A string of MATCH bytes as one value; numpy drops zero bytes at the end of such values, which all have one width.
STRING = f"S{MATCH}"


def by_bytes(content: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an example of each kind, kind of each piece): pieces are of one kind if their bytes are equal; content: a hash of each."""
    _, sample, kind = np.unique(content, return_index=True, return_inverse=True)
    odd = np.flatnonzero(sizes != sizes[sample[kind]])
    for a, b in runs(np.append(0, np.cumsum(sizes))):
        like = sample[kind[a:b]]
        same = sizes[a:b] == sizes[like]
        length = np.where(same, sizes[a:b], 0)
        apart = gather(text, starts[a:b], length) != gather(text, starts[like], length)
        if apart.any():
            odd = np.union1d(odd, a + np.repeat(np.arange(b - a), length)[apart])
    if len(odd):  # different pieces of one hash get kinds of their own
        found: dict[tuple[int, bytes], int] = {}
        for i in odd:
            key = (int(kind[i]), text[starts[i] : starts[i] + sizes[i]].tobytes())
            if key not in found:
                found[key] = len(sample)
                sample = np.append(sample, i)
            kind[i] = found[key]
    return sample, kind


def ranges_by_block(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    order = np.argsort(block, kind="stable")
    block, starts, ends = block[order], starts[order].astype(np.int32), ends[order].astype(np.int32)
    heads = np.append(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), len(block)) if len(block) else np.zeros(1, int)
    return [(0, int(block[a]), starts[a:b].tobytes(), ends[a:b].tobytes(), None, None) for a, b in zip(heads[:-1], heads[1:], strict=True)]


def as_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FOUND_ARROW)], schema=FOUND_ARROW)


def decide(bits: int):
    """The removed ranges of one shard; for a spread shard also what it can't decide alone, by range of fingerprint."""

    def apply(table: pa.Table) -> pa.Table:
        spread = bool(table["shard"][0].as_py() & ((1 << SHIFT) - 1))
        join = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c]])
        own, doc, first, size = join("owners", np.uint32), join("docs", np.int64), join("firsts", np.int32).astype(np.int64), join("sizes", np.int32).astype(np.int64)
        text = np.concatenate([np.frombuffer(pa.decompress(x.as_buffer(), int(np.frombuffer(n.as_buffer(), np.int32).sum()), codec="zstd"), np.uint8) for x, n in zip(table["text"], table["sizes"], strict=True)])
        per = [len(x.as_buffer()) // 4 for x in table["owners"]]
        block = np.repeat(table["block"].to_numpy(), per)
        ends = np.cumsum(size)
        starts = ends - size
        hashes = np.empty(len(size), U)
        bounds = np.append(starts, len(text))
        for a, b in runs(bounds):
            sums = prefix_sums(text[bounds[a] : bounds[b]], EXACT)
            hashes[a:b] = range_hash(sums, starts[a:b] - bounds[a], ends[a:b] - bounds[a])
        content = mix(hashes + mix(size.astype(U) ^ (own.astype(U) << U(32))))
        sample, kind = by_bytes(content, text, starts, size)
        least = np.full(len(sample), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, doc)
        later = doc > least[kind]  # an equal piece stands in a smaller document
        out = ranges_by_block(block[later], first[later], first[later] + size[later])

        def decide_pieces(chosen: np.ndarray) -> list[tuple]:
            """Ranges, and for a spread shard open strings, of distinct pieces that hold all of their owners."""
            length = size[sample[chosen]]
            data = gather(text, starts[sample[chosen]], length)
            stop = np.cumsum(length)
            base = stop - length
            piece = np.repeat(np.arange(len(chosen)), length)
            valid = np.arange(len(data)) + MATCH <= stop[piece]
            owner_of = least[chosen][piece]
            sa = suffix_array(data)  # in full order, which common_prefixes() needs
            classes = np.cumsum(common_prefixes(data, sa, MATCH) < MATCH)
            ok = valid[sa]
            spots, classes = sa[ok], classes[ok]
            low = np.full(int(classes[-1]) + 1 if len(classes) else 1, np.iinfo(np.int64).max)
            np.minimum.at(low, classes, owner_of[spots])
            mark = np.zeros(len(data), bool)
            mark[spots] = low[classes] < owner_of[spots]
            where = np.full(len(sample), -1)
            where[chosen] = np.arange(len(chosen))
            lead = leaders[where[kind[leaders]] >= 0]
            lead = lead[np.argsort(where[kind[lead]], kind="stable")]
            mine = where[kind[lead]]

            def spread_out(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Positions in data to every leading occurrence of their piece: (occurrence, offset in the piece)."""
                p = piece[positions]
                a, b = np.searchsorted(mine, p), np.searchsorted(mine, p, "right")
                times = b - a
                total = np.cumsum(times)
                at = np.arange(total[-1] if len(total) else 0) - np.repeat(total - times, times) + np.repeat(a, times)
                return lead[at], np.repeat(positions - base[p], times)

            who, off = spread_out(np.flatnonzero(mark))
            rows = ranges_by_block(block[who], first[who] + off, first[who] + off + MATCH)
            if not spread:
                return rows
            open_ = np.sort(spots[~mark[spots]])
            prints = np.empty(len(open_), U)
            bounds = np.append(base, len(data))
            for a, b in runs(bounds):
                lo, hi = np.searchsorted(open_, (bounds[a], bounds[b]))
                if hi > lo:
                    sums = prefix_sums(data[bounds[a] : bounds[b]], EXACT)
                    prints[lo:hi] = mix(range_hash(sums, open_[lo:hi] - bounds[a], open_[lo:hi] - bounds[a] + MATCH))
            who, off = spread_out(open_)
            place = np.searchsorted(open_, base[where[kind[who]]] + off)
            order = np.argsort(prints[place])
            place, who, off = place[order], who[order], off[order]
            edges = np.searchsorted(prints[place] >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
            for k in np.flatnonzero(np.diff(edges)):
                s = slice(edges[k], edges[k + 1])
                w = who[s]
                at = open_[place[s]]
                strings = gather(data, at, np.full(len(at), MATCH))
                rows.append((1, int(k), pa.compress(strings.tobytes(), codec="zstd", asbytes=True), doc[w].tobytes(), block[w].tobytes(), (first[w] + off[s]).astype(np.int64).tobytes()))
            return rows

        distinct = own[sample]
        _, place, n = np.unique(distinct, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(spread | (n[place] > 1))
        if not len(chosen):
            return as_table(out)
        chosen = chosen[np.argsort(distinct[chosen], kind="stable")]
        leaders = np.flatnonzero(~later)
        for part in portions(distinct[chosen], size[sample[chosen]]):
            out += decide_pieces(chosen[part])
        return as_table(out)

    return apply


def merge(table: pa.Table) -> pa.Table:
    """Strings of spread shards, merged by binary search: all but those of the smallest document are removed."""
    read = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[c]]
    docs, blocks, spots = read("b", np.int64), read("c", np.int64), read("d", np.int64)
    keys = [np.frombuffer(pa.decompress(x.as_buffer(), MATCH * len(d), codec="zstd"), STRING) for x, d in zip(table["a"], docs, strict=True)]
    all_keys, least = merge_shards([smallest(k, d) for k, d in zip(keys, docs, strict=True)])
    doc, block, spot = (np.concatenate(x) for x in (docs, blocks, spots))
    gone = least[np.searchsorted(all_keys, np.concatenate(keys))] < doc
    return as_table(ranges_by_block(block[gone], spot[gone], spot[gone] + MATCH))


def cut_out(names: list[str], text: bool):
    """Blocks with their removed ranges to one row for each document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(5).to_pylist()
            rest = batch.column(4)
            for _, ids, offsets, raw, i in unpack(batch):
                depth = np.zeros(len(raw) + 1, np.int32)
                for r in found[i] or []:
                    np.add.at(depth, np.frombuffer(r["a"], np.int32), 1)
                    np.add.at(depth, np.frombuffer(r["b"], np.int32), -1)
                gone = np.cumsum(depth[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = offsets[:-1][np.diff(offsets) > 0]
                begins[heads] = gone[heads]
                count = lambda m: np.diff(np.concatenate(([0], np.cumsum(m, dtype=np.int64)))[offsets])
                removed, spans = count(gone), count(begins)
                kept = [raw[a:b] if not r else raw[a:b][~gone[a:b]] for a, b, r in zip(offsets[:-1], offsets[1:], removed, strict=True)]
                columns = pa.ipc.open_stream(rest[i].as_buffer()).read_next_batch().columns
                columns += [pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
                columns.append(pa.array([k.tobytes().decode("utf-8", "ignore") for k in kept] if text else [hashlib.sha256(k.tobytes()).hexdigest() for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return apply


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", kept_text: bool = False, block_bytes: int = BLOCK_BYTES, spread: int = SPREAD) -> DataFrame:
    """Every row of docs without its text column, with n_bytes, n_removed, n_spans and what is left of the text.

    kept_text: return the text that is left (bytes of a character that is cut in two are left out), else kept_sha256,
    the digest of the bytes that are left.
    """
    spark = docs.sparkSession
    result = "kept_text" if kept_text else "kept_sha256"
    rest = [c for c in docs.columns if c not in (text, id_column, "n_bytes", "n_removed", "n_spans", result)]
    names = [id_column, *rest]
    plain = docs.select(F.col(id_column).cast("long").alias("_id"), *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(rest)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    held = ["_id", *[f"_r{i}" for i in range(len(rest))]]
    size = F.octet_length("_text").cast("long")
    digest = F.sha2(F.col("_text"), 256)
    known = mark_copies(plain, "_id", F.col("_text"))
    copy = F.coalesce(F.col("_first") < F.col("_id"), F.lit(False)) & (size >= MATCH)
    alone = (size < MATCH) | F.col("_id").isNull()
    whole = F.col("_text") if kept_text else digest
    empty = F.lit("") if kept_text else F.sha2(F.lit(""), 256)
    easy = known.filter(copy | alone).select(
        *held, size.alias("n_bytes"), F.when(copy, size).otherwise(F.lit(0).cast("long")).alias("n_removed"), copy.cast("long").alias("n_spans"), F.when(copy, empty).otherwise(whole).alias(result)
    )
    hard = known.filter(~(copy | alone)).select(*held, "_text").mapInArrow(pack(block_bytes), "block long, ids binary, offsets binary, raw binary, rest binary")
    blocks = materialise(hard, "blocks")
    bits = bits_for(spark, blocks.count())
    schema = T.StructType([*[T.StructField(h, plain.schema[h].dataType) for h in held], *[T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")], T.StructField(result, T.StringType())])
    asked = blocks.select("block", "ids", "offsets", "raw").mapInArrow(ask(bits), "range long, block long, keys binary, counts binary")
    codes = asked.groupBy("range").applyInArrow(answer(spread), "block long, range long, codes binary").groupBy("block").agg(F.collect_list(F.struct("range", "codes")).alias("codes"))
    sent = blocks.join(codes, "block").select("block", "ids", "offsets", "raw", F.lit(None).cast("binary").alias("rest"), "codes").mapInArrow(
        pieces(bits), "shard long, block long, owners binary, docs binary, firsts binary, sizes binary, text binary"
    )
    relieve(spark)  # workers and heap together have to stay within an executor
    found = materialise(sent.groupBy("shard").applyInArrow(decide(bits), FOUND), "ranges")
    relieve(spark)
    merged = found.filter("kind = 1").groupBy("key").applyInArrow(merge, FOUND)
    ranges = found.filter("kind = 0").unionByName(merged).groupBy(F.col("key").alias("block")).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    cut = blocks.join(ranges, "block", "left").select("block", "ids", "offsets", "raw", "rest", "ranges").mapInArrow(cut_out([f.name for f in schema], kept_text), schema)
    out = easy.unionByName(cut)
    out = materialise(out.select(*[F.col(h).alias(c) for h, c in zip(held, names, strict=True)], "n_bytes", "n_removed", "n_spans", result), "left")
    for used in (blocks, found):
        release(used)
    return out
