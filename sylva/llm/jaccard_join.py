"""Exact Jaccard self-join of documents on word shingles, by prefixes of token combinations.

Shingles are ordered by frequency class (a count sketch of fixed size gives every shingle its class, the same for
all documents) and hash. A document of n shingles may miss t = n - ceil(threshold * n) of them in a partner. Its
prefix is the shortest one that t misses can't exhaust: a rare shingle is indexed alone, so one miss removes one
signature; shingles of a frequent class are indexed in combinations of k within small groups, where n shingles
outlast n - k misses. So each linked pair shares a signature, whatever the classes are.

Signatures meet by range. Each set of documents with a common signature gives links to its smallest member first
(a star); these are verified exactly on whole shingle sets. Documents of sets of three or more then meet once more, each
with its component so far, and only sets whose members are still in different components leave the ranges and give the
pairs that are left, which are verified too. So groups of copies cost as many pairs as they have members, a component is
looked up once for each document and not for each set, and no pair that could matter is left out.

Documents that share many signatures would meet in as many ranges. So a document takes its marks along, the signatures
that a second hash puts first: where documents have a mark in common they are known to meet at it, and what they share
behind it is left out. What leaves the ranges then doesn't grow with their number but for documents that share little.

Nulls: a null text is empty; an empty set is linked with nothing; a row with a null id is a component of its own.
Repeated rows: rows that share an id share its component. Texts of any length are compared whole. Extra columns are
ignored whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.components import components
from sylva.llm.copies import mark_copies
from sylva.llm.hashing import U, mix, runs, shingles, utf8, words
from sylva.runtime import give_back, materialise, release

SKETCH_BITS = 20
SKETCH_RANGE = 14
#: Documents of fewer shingles than 2**SMALL index single shingles only.
SMALL = 6
#: Shingles of a set for each group of a frequent class.
GROUPED = 16
#: Ids of candidate documents in one broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: log2 of the numbers in a short profile at most, and how many there are for a shingle up to that.
SHORT, FINE = 10, 4.0
#: Signatures in one range, about.
RANGE_SIGNATURES = 1 << 18
#: Members of a set that may go into a larger one at least.
GATHERED = 8
#: Marks of a document.
MARKS = 2


def document_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of a batch whose second column is the text."""
    raw, offsets = utf8(batch.column(1))
    for a, b in runs(offsets):
        found, per = shingles(*words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), k)
        ends = np.cumsum(per)
        for i in range(b - a):
            yield a + i, np.unique(found[ends[i] - per[i] : ends[i]])


def sketch(k: int):
    """Counts of shingles by the first bits of their hash, one set of counters for each task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.int64), False
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in runs(offsets):
                found, _ = shingles(*words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), k)
                seen |= len(found) > 0
                counts += np.bincount((found >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        if seen:
            parts = counts.astype(np.int32).reshape(-1, 1 << SKETCH_RANGE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    return apply


def add_up(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << SKETCH_RANGE, np.int64)
    for x in table["counts"]:
        total += np.frombuffer(x.as_buffer(), np.int32)
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def frequency_classes(docs: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Class of each counter: 0 rare, 1 frequent, 2 very frequent, in 2**SKETCH_BITS bytes whatever the input is; and how many shingles were counted.

    Rare is what a counter holds by chance: its mean, six standard deviations and some copies more.
    """
    parts = docs.select("doc_id", "text").mapInArrow(sketch(k), "part long, counts binary").groupBy("part").applyInArrow(add_up, "part long, counts binary")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.toLocalIterator():
        counts[row["part"] << SKETCH_RANGE : (row["part"] + 1) << SKETCH_RANGE] = np.frombuffer(row["counts"], np.int64)
    mean = counts.mean()
    often = mean + 6 * np.sqrt(mean) + 32
    return (counts > often).astype(np.uint8) + (counts > 16 * often).astype(np.uint8), int(counts.sum())


def signatures(tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set: sorted tokens with their classes; two sets whose similarity is percent or more share one."""
    n = len(tokens)
    least = -(-percent * n // 100)
    misses = n - least
    rare = tokens[classes == 0]
    if len(rare) > misses:
        return rare[: misses + 1]
    order = np.argsort(classes, kind="stable")
    tokens, classes = tokens[order], classes[order]
    out = []
    for level in range(max(least, 1).bit_length() - 1, max(n * 100 // percent, 1).bit_length()):
        kinds = classes.astype(np.int64) if level >= SMALL else np.zeros(n, np.int64)
        groups = max(1, (1 << level) // GROUPED)
        group = np.where(kinds > 0, (tokens % U(groups)).astype(np.int64) + groups * kinds, 0)
        by = np.argsort(group, kind="stable")
        heads = np.concatenate(([True], group[by][1:] != group[by][:-1]))
        rank = np.empty(n, np.int64)
        rank[by] = np.arange(n) - np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        enough = np.flatnonzero(np.cumsum(rank >= kinds) > misses)  # the (k+1)th of a group outlasts one miss more
        end = enough[0] + 1 if len(enough) else n
        out.append(tokens[:end][kinds[:end] == 0])
        for g in np.unique(group[:end][kinds[:end] > 0]):
            members = tokens[:end][group[:end] == g]
            size = int(g // groups) + 1
            if len(members) >= size:
                combos = np.array(list(combinations(np.sort(members).tolist(), size)), U)
                out.append(mix((combos * (np.arange(size, dtype=U) * U(2) + U(0x9E3779B97F4A7C15))).sum(axis=1, dtype=U) + U(level)))
    return np.unique(np.concatenate(out))


def places(part: np.ndarray | int, sig: np.ndarray) -> np.ndarray:
    """The places of signatures in the order of the second hash, by their ranges and what is kept of them beside."""
    return mix((np.asarray(part, np.int64).astype(U) << U(32)) | sig.astype(U))


def lowest(place: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The MARKS lowest of each run of `per` places as a row; of fewer, the last stands again."""
    ends = np.cumsum(per)
    place = place[np.lexsort((place, np.repeat(np.arange(len(per)), per)))]
    rank = np.minimum(np.arange(MARKS), np.maximum(per, 1)[:, None] - 1)
    return place[np.minimum((ends - per)[:, None] + rank, max(len(place) - 1, 0))] if len(place) else np.zeros((len(per), MARKS), U)


def index(k: int, percent: int, bits: int, classes_of, rooted: bool = False):
    """Rows of kind 0 with the size of each set, and of kind 1 with the signatures of a batch by range and the marks of their documents; rooted: a third column goes along with these."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "a", "b", "c", "marks", *(["d"] if rooted else [])]
        classes = classes_of.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes, parts = np.zeros(len(ids), np.int64), []
            for row, tokens in document_sets(batch, k):
                sizes[row] = len(tokens)
                parts.append(signatures(tokens, classes[(tokens >> U(64 - SKETCH_BITS)).astype(np.int64)], percent) if len(tokens) else tokens)
            if not rooted:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), sizes.tobytes(), None, None))], names=names)
            if not parts:
                continue
            per = [len(p) for p in parts]
            sig, doc, size = np.concatenate(parts), np.repeat(ids, per), np.repeat(sizes, per)
            part, sig = (sig >> U(64 - bits)).astype(np.int64), (sig >> U(32 - bits)).astype(np.uint32)
            marks = np.repeat(lowest(places(part, sig), np.array(per)), per, axis=0)
            order = np.argsort(part, kind="stable")
            part, sig, doc, size, marks = part[order], sig[order], doc[order], size[order].astype(np.int32), marks[order]
            heads = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part)) if len(part) else np.zeros(1, np.int64)
            cut = lambda x, h=heads: pa.array([x[a:b].tobytes() for a, b in zip(h[:-1], h[1:], strict=True)], pa.binary())
            more = [cut(np.repeat(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), per)[order])] if rooted else []
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(heads) - 1), pa.int32()), pa.array(part[heads[:-1]], pa.int64()), cut(sig), cut(doc), cut(size), cut(marks), *more], names=names)
        give_back()

    return apply


PAIRS = "kind int, a long, b long, n int"


def common_sets(table: pa.Table, percent: int) -> tuple[np.ndarray, ...]:
    """Sets of two or more documents with a common signature, and of sizes that similar ones can have, in one range, each once.

    Gives (set, document, size, marks) by member, sets together and their documents ascending, the index of the rows of their signatures, and the
    place of each set's signature, the first if it has several. Without marks in the table the places are 0, before all marks.
    """
    join = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]])
    sig, doc, size = join("a", np.uint32), join("b", np.int64), join("c", np.int32)
    row = np.lexsort((doc, size, sig))
    sig, doc, size = sig[row], doc[row], size[row]
    # A step in size that no similar pair spans parts a set in two.
    apart = (sig[1:] != sig[:-1]) | (100 * size[:-1].astype(np.int64) < percent * size[1:].astype(np.int64))
    run = np.cumsum(np.concatenate(([False], apart)), dtype=np.int32)
    del apart
    order = np.lexsort((doc, run))
    row, run, doc, size, sig = row[order], run[order], doc[order], size[order], sig[order]
    fresh = np.concatenate(([True], (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])))
    row, run, doc, size, sig = row[fresh], run[fresh], doc[fresh], size[fresh], sig[fresh]
    heads = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    length = np.diff(np.append(heads, len(run)))
    # Equal sets of documents count once: a sum of mixed ids stands for the set.
    digest = np.add.reduceat(mix(doc.astype(U)), heads) + length.astype(U)
    marked = "marks" in table.column_names
    place = places(table["key"][0].as_py(), sig[heads]) if marked else np.zeros(len(heads), U)
    early = np.argsort(place, kind="stable")
    first = early[np.unique(digest[early], return_index=True)[1]]
    first = first[length[first] > 1]
    heads, length, place = heads[first], length[first], place[first]
    total = np.cumsum(length)
    at = np.arange(total[-1] if len(total) else 0) - np.repeat(total - length, length) + np.repeat(heads, length)
    marks = join("marks", U).reshape(-1, MARKS)[row[at]] if marked else np.zeros((len(at), MARKS), U)
    return np.repeat(np.arange(len(heads)), length), doc[at], size[at], marks, row[at], place


def alike(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which sizes are near enough for similar sets."""
    return 100 * np.minimum(m, n).astype(np.int64) >= percent * np.maximum(m, n).astype(np.int64)


def known_before(group: np.ndarray, size: np.ndarray, marks: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which members have a mark before the place of their set in common with two others of near sizes: at it they are in a set of three or more too."""
    member, which = np.nonzero(marks < place[group][:, None])
    own = (which == 0) | (marks[member, which] != marks[member, 0])  # a mark that stands twice counts once
    member, mark = member[own], marks[member[own], which[own]]
    order = np.lexsort((size[member], mark, group[member]))
    member, mark = member[order], mark[order]
    n, at = len(member), np.arange(len(member))

    def near(step: int) -> np.ndarray:
        there = (at + step).clip(0, n - 1)
        same = (at + step == there) & (group[member] == group[member[there]]) & (mark == mark[there])
        return same & alike(size[member], size[member[there]], percent)

    out = np.zeros(len(group), bool)
    if n:
        before, behind = near(-1), near(1)
        out[member[(before & behind) | (before & near(-2)) | (behind & near(2))]] = True
    return out


def meet(percent: int):
    """Documents that meet in one range: rows of kind 0 are links to try, those of kind 1 the documents of sets of three or more, each once.

    Left out is what a common mark shows to meet at an earlier place. Of all that two documents share, or all sets of three or more that one is
    in, the one at the first place is never left out, so each is in some range's rows.
    """

    def apply(table: pa.Table) -> pa.Table:
        found = met(table)
        give_back()
        return found

    def met(table: pa.Table) -> pa.Table:
        group, doc, size, marks, _, place = common_sets(table, percent)
        head = np.searchsorted(group, group)
        common = (marks[:, :, None] == marks[head][:, None, :]) & (marks < place[group][:, None])[:, :, None]
        close = (head != np.arange(len(head))) & alike(size, size[head], percent) & ~common.any((1, 2))
        pairs = np.unique(np.stack((doc[head[close]], doc[close])), axis=1)
        many = np.flatnonzero((np.bincount(group) > 2)[group] & ~known_before(group, size, marks, place, percent)) if len(group) else group
        members, at = np.unique(doc[many], return_index=True)
        n = pairs.shape[1]
        return pa.table({
            "kind": pa.array(np.concatenate((np.zeros(n), np.ones(len(members)))), pa.int32()),
            "a": pa.array(np.concatenate((pairs[0], members)), pa.int64()),
            "b": pa.array(np.concatenate((pairs[1], members)), pa.int64()),
            "n": pa.array(np.concatenate((np.zeros(n, np.int32), size[many[at]])), pa.int32()),
        })

    return apply


SETS = "set long, b long, n int, root long"


def gathered(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, index) of the members of fewer sets that hold every pair of the given ones (group, ascending): a set goes into a larger one that has three quarters of it.

    A set doesn't grow by more than half of what it was, so that its pairs stay of the order that they had. Small sets are left alone.
    """
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    length = np.diff(np.append(heads, len(group)))
    _, place = np.unique(doc, return_inverse=True)
    home, to, base, held = np.full(len(doc), -1), np.arange(len(heads)), length.copy(), length.copy()
    for k in np.argsort(-length, kind="stable"):
        if length[k] < GATHERED:
            break
        own = place[heads[k] : heads[k] + length[k]]
        homes = home[own]
        names, counts = np.unique(homes[homes >= 0], return_counts=True)
        if len(names):
            most = counts.argmax()
            into, fresh = names[most], length[k] - counts[most]
            if 4 * counts[most] >= 3 * length[k] and 2 * (held[into] + fresh) <= 3 * base[into]:
                to[k] = into
                held[into] += fresh
        home[own[homes < 0]] = to[k]
    group = np.repeat(to, length)
    at = np.lexsort((doc, group))
    group, own = group[at], place[at]
    fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (own[1:] != own[:-1])))
    return group[fresh], at[fresh]


def still_apart(percent: int):
    """Members of sets that hold the pairs of those of three or more documents in one range whose roots (d) are not all the same.

    A set is left out if its members have a mark in common that stands before it: the set at that mark holds them all.
    """

    def apply(table: pa.Table) -> pa.Table:
        found = met(table)
        give_back()
        return found

    def met(table: pa.Table) -> pa.Table:
        group, doc, size, marks, row, place = common_sets(table, percent)
        root = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["d"]])[row]
        if len(group):
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            open_sets = (np.minimum.reduceat(root, heads) < np.maximum.reduceat(root, heads)) & (np.bincount(group) > 2)
            for mark in marks[heads].T:
                open_sets &= (mark >= place) | ~np.logical_and.reduceat((marks == mark[group][:, None]).any(1), heads)
            group, doc, size, root = (x[open_sets[group]] for x in (group, doc, size, root))
        if len(group):
            group, at = gathered(group, doc)
            doc, size, root = doc[at], size[at], root[at]
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            length = np.diff(np.append(heads, len(group)))
            digest = np.repeat(mix(np.add.reduceat(mix(doc.astype(U)), heads) + length.astype(U)), length).view(np.int64)
        else:
            digest = np.zeros(0, np.int64)
        return pa.table({"set": pa.array(digest, pa.int64()), "b": pa.array(doc, pa.int64()), "n": pa.array(size, pa.int32()), "root": pa.array(root, pa.int64())})

    return apply


def left_over(percent: int, pack: bool = False):
    """Pairs of one set of documents that are in different components, of near sizes, and not ruled out by their short profiles.

    Every document is held against a row of others at once; only pairs that could be similar leave the task.
    """

    def apply(table: pa.Table) -> pa.Table:
        doc, root, size = (table[c].to_numpy() for c in ("b", "root", "n"))
        order = np.lexsort((doc, size))
        doc, root, size = doc[order], root[order], size[order].astype(np.int64)
        raw = [unpacked(table["profile"][int(i)], pack) for i in order]
        length = np.array([len(x) for x in raw])
        far = np.searchsorted(size, size * 100 // percent, "right")
        found = []
        # Sizes that are near have profiles of one or two lengths, as these are powers of two; the longer are folded.
        for width in np.unique(length):
            rows = np.flatnonzero(length >= width) if width else np.arange(len(doc))
            folded = np.stack([raw[i].reshape(width, -1).sum(1) for i in rows]).astype(np.int32) if width else None
            place = {int(i): k for k, i in enumerate(rows)}
            for i in np.flatnonzero(length == width):
                low = np.searchsorted(size, -(-size[i] * percent // 100))
                j = np.arange(low, far[i])
                # A pair is made by the shorter profile, between equal ones by the first.
                j = j[(root[j] != root[i]) & ((length[j] > width) | ((length[j] == width) & (j > i)))]
                if width and len(j):
                    bound = np.minimum(folded[place[int(i)]], folded[np.searchsorted(rows, j)]).sum(1)
                    j = j[100 * bound >= percent * (size[i] + size[j] - bound)]
                if len(j):
                    found.append(np.stack((np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]))))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return apply


def whole_sets(k: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for _, s in document_sets(batch, k)]
            for a in range(0, len(sets), 500):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), pa.array(sets[a : a + 500], pa.binary())], names=["doc", "tokens"])
        give_back()

    return apply


def similar(percent: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs are merged
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return apply


def packed(counts: np.ndarray, bits: int) -> bytes:
    """A profile of 2**bits counts in a byte for the bits, and compressed: most counts are small."""
    return bytes([bits]) + pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def unpacked(profile: pa.BinaryScalar, pack: bool = True) -> np.ndarray:
    """Counts of a profile, packed or plain; none of a null."""
    if not profile.is_valid:
        return np.zeros(0, np.uint8)
    data = profile.as_buffer()
    return np.frombuffer(pa.decompress(data.slice(1), 1 << data[0], codec="zstd") if pack else data, np.uint8)


def profiles(k: int, most: int = 32, fine: float = 0.5, pack: bool = False):
    """How many shingles each document has in each of fine * n / 2 to fine * n equal ranges of hashes (a power of two, 2**most at most)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            for _, tokens in document_sets(batch, k):
                bits = min(most, max(1, int(len(tokens) * fine / 2).bit_length()))
                counts = np.bincount((tokens >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
                sizes.append(len(tokens))
                out.append(None if counts.max() > 255 else packed(counts.astype(np.uint8), bits) if pack else counts.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["doc", "size", "profile"])

    return apply


def could_be_similar(percent: int):
    """Pairs but for those whose profiles rule out that they are similar: no more shingles are common than the smaller counts add up to."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(i).to_pylist() for i in (2, 4)]
            keep = []
            for x, y, m, n in zip(batch.column(3), batch.column(5), *sizes, strict=True):
                bound = min(m, n)
                if x.is_valid and y.is_valid:
                    x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                    few = min(len(x), len(y))
                    bound = int(np.minimum(x.reshape(few, -1).sum(1), y.reshape(few, -1).sum(1)).sum())
                keep.append(100 * bound >= percent * (m + n - bound))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return apply


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents with these ids; few ids are broadcast."""
    ids = materialise(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["_id"], "left_semi").select("doc_id", "text")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct())


def linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, verified on the whole sets."""
    pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
    known = materialise(texts_of(ends(pairs), docs).mapInArrow(profiles(k), "doc long, size long, profile binary"), "profiles")
    x, y = (known.select(F.col("doc").alias(d), F.col("size").alias(f"{d}_size"), F.col("profile").alias(f"{d}_profile")) for d in "ab")
    near = pairs.join(x, "a").join(y, "b").select("a", "b", "a_size", "a_profile", "b_size", "b_profile").mapInArrow(could_be_similar(percent), "a long, b long")
    near = materialise(near.distinct(), "near")
    sets = materialise(texts_of(ends(near), docs).mapInArrow(whole_sets(k), "doc long, tokens binary"), "sets")
    x, y = (sets.select(F.col("doc").alias(d), F.col("tokens").alias(t)) for d, t in (("a", "x"), ("b", "y")))
    found = near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(similar(percent), "a long, b long")
    found = materialise(found.distinct(), "similar")
    for used in (pairs, known, near, sets):
        release(used)
    return found


def bits_for(total: int, percent: int) -> int:
    """log2 of the number of ranges for the signatures of `total` shingles: a range holds about as many whatever the session is, and documents that share several signatures in one meet there once."""
    return max(1, (-(-total * (100 - percent) // (100 * RANGE_SIGNATURES))).bit_length())


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id that links of similarity percent / 100 reach."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = mark_copies(rows, "doc_id", F.col("text"))
    own = marked.filter(F.col("doc_id").isNotNull() & (F.col("_first").isNull() | (F.col("_first") == F.col("doc_id")))).select("doc_id", "text")
    classes, total = frequency_classes(own, k)
    classes = spark.sparkContext.broadcast(classes)
    bits = bits_for(total, percent)
    indexed = materialise(own.mapInArrow(index(k, percent, bits, classes), "kind int, key long, a binary, b binary, c binary, marks binary"), "signatures")
    tried = materialise(indexed.filter("kind = 1").groupBy("key").applyInArrow(meet(percent), PAIRS), "meetings")
    links = linked(tried.filter("kind = 0"), own, k, percent)
    roots = materialise(components(links), "roots")
    members = tried.filter("kind = 1").select("b").distinct().join(roots.select(F.col("node").alias("b"), "root"), "b", "left")
    members = materialise(members.select(F.col("b").alias("_id"), F.coalesce("root", "b").alias("_root")), "members")
    few = members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    again = own.join(F.broadcast(members) if few else members, own["doc_id"] == members["_id"]).select("doc_id", "text", "_root")
    again = again.mapInArrow(index(k, percent, bits, classes, True), "kind int, key long, a binary, b binary, c binary, marks binary, d binary")
    live = materialise(again.groupBy("key").applyInArrow(still_apart(percent), SETS).distinct(), "live")
    short = texts_of(live.select("b"), own).mapInArrow(profiles(k, SHORT, FINE, True), "doc long, size long, profile binary").groupBy("doc").agg(F.max("profile").alias("profile"))
    rest = live.join(short, live["b"] == short["doc"]).select("set", "b", "n", "root", "profile").groupBy("set").applyInArrow(left_over(percent, True), "a long, b long")
    more = linked(rest, own, k, percent)
    roots = materialise(components(links.unionByName(more)), "roots")
    sizes = indexed.filter("kind = 0").mapInArrow(unpack_sizes, "_id long, n_shingles long")
    sizes = sizes.groupBy("_id").agg(F.max("n_shingles").alias("n_shingles"))
    lead = marked.select("doc_id", F.coalesce("_first", "doc_id").alias("_lead"), F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"))
    known = lead.join(sizes, lead["_lead"] == sizes["_id"], "left").join(roots, F.col("_lead") == F.col("node"), "left")
    named = known.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.when(F.col("n_shingles") > 0, F.coalesce("root", "_lead")).otherwise(F.col("doc_id")).alias("component_id"))
    unnamed = lead.filter(F.col("doc_id").isNull()).mapInArrow(null_sizes(k), "doc_id long, n_shingles long, component_id long")
    return named.unionByName(unnamed)


def unpack_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (a, b)], names=["_id", "n_shingles"])


def null_sizes(k: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(s) for _, s in document_sets(pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["doc_id", "text"]), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return apply
