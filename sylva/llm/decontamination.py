"""Benchmark decontamination in column expressions only.

1. Windows as long as a benchmark item. Similarity s needs s / (1 + s) of the shingles of window and item together to
   be common, so a window is cut only where that many of its shingles stand in items of its length, whichever these
   are, and where it begins (or, at the end of a text, closes) with one of them. No similar window is left out.
2. Each window and each item gets a SimHash fingerprint of 64 bits over its word shingles.
3. Windows and items of a length meet by blocks of their fingerprints: BLOCKS blocks of 16 bits, each looked up within
   FLIPS changed bits. Fingerprints within RADIUS = BLOCKS * (FLIPS + 1) - 1 bits differ in FLIPS bits at most in one
   block, so all of them meet; others go by their Hamming distance. Nothing else gives pairs of windows and items.
4. The pairs are verified by exact weighted-shingle similarity: the sum of the smaller counts over that of the larger.

Recall: a window whose similarity is just 0.8 lies within the radius with a probability of 0.974 at least (simulated
for 10 to 300 shingles); one of 0.9 in practice always.

Items of fewer words than a shingle are one shingle of their own length. Nulls: null texts and items have no words
and match nothing; a null item id is an item too. Rows that repeat an id and text are one document; ties go to the
first of the windows. Texts of any length are cut whole. Extra columns of both tables are ignored whatever their names;
without_leaks() returns those of docs. Empty tables work.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.quality import let
from sylva.runtime import materialise

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of 16 bits of a fingerprint, and the changed bits within which windows and items look each other up.
BLOCKS, WINDOW_FLIPS, ITEM_FLIPS = 4, 1, 2
FLIPS = WINDOW_FLIPS + ITEM_FLIPS
#: Bits in which fingerprints may differ. Similarity 0.8 gives 9.7 bits of 64 in the mean with a deviation of 2.9.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Rows in one broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(w: Column, k: int) -> Column:
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return let(w, lambda w: F.when(F.size(w) >= k, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def shingles_by(w: Column, k: Column) -> Column:
    """Shingle hashes of as many words as k says, SHINGLE at most."""
    out = F.when(k == SHINGLE, shingle_hashes(w, SHINGLE))
    for n in range(1, SHINGLE):
        out = out.when(k == n, shingle_hashes(w, n))
    return out


def simhash(hashes: Column) -> Column:
    """64 bits: each is the majority of that bit over all shingles, each as often as it stands there."""
    vote = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.when(vote(b) > 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a))


def block_keys(fingerprint: Column, flips: int) -> Column:
    """Numbers of a fingerprint's blocks, each with every choice of at most that many of its bits changed."""
    masks = F.array(*[F.lit(sum(1 << b for b in bits)).cast("long") for n in range(flips + 1) for bits in combinations(range(16), n)])
    block = lambda b: F.call_function("shiftrightunsigned", fingerprint, b * 16).bitwiseAND(F.lit(0xFFFF))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: let(block(b), lambda bits: F.transform(masks, lambda m: b * 65536 + bits.bitwiseXOR(m)))))


def numbered(hashes: Column) -> Column:
    """Each occurrence of a shingle told apart by its number, so that common occurrences are a set intersection."""
    return let(F.sort_array(hashes), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x))))


def few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(_item, item_id, length, k, hashes) of every item with words; k: words in its shingles."""
    items = benchmark.select("item_id", words_of("text").alias("w")).withColumn("length", F.size("w")).filter("length > 0")
    items = items.withColumn("k", F.least(F.col("length"), F.lit(SHINGLE))).withColumn("hashes", shingles_by(F.col("w"), F.col("k")))
    return items.select(F.xxhash64("item_id", "w").alias("_item"), "item_id", "length", "k", "hashes").dropDuplicates(["_item"])


def windows_of(docs: DataFrame, items: DataFrame, row: Column, text: str, similarity: float) -> DataFrame:
    """(_row, length, k, starts): where windows of each item length begin that could be similar to an item of that length."""
    hits = None
    for (k,) in items.select("k").distinct().collect() or [(SHINGLE,)]:  # SHINGLE values at most
        grams = items.filter(F.col("k") == k).select("length", F.explode("hashes").alias("hash")).distinct()
        grams = F.broadcast(grams) if few(grams) else grams
        spots = docs.select(row.alias("_row"), words_of(text).alias("w")).select("_row", F.size("w").alias("n_words"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "hash"))
        found = spots.join(grams, "hash").select("_row", "n_words", "length", F.lit(k).alias("k"), "pos")
        hits = found if hits is None else hits.unionByName(found)
    # Positions in a document of shingles of items of one length, in order: at most one for each word of the document.
    spans = hits.groupBy("_row", "length", "n_words", "k").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    in_item = F.col("length") - F.col("k") + 1
    in_window = F.least("length", "n_words") - F.col("k") + 1
    need = F.ceil((in_item + in_window) * similarity / (1 + similarity) - 1e-9).cast("int")
    last = F.greatest(F.col("n_words") - F.col("length"), F.lit(0))
    spans = spans.withColumn("need", F.greatest(need, F.lit(1))).withColumn("last", last)
    opens = F.filter(F.transform("at", lambda p, i: F.when(F.get("at", i + F.col("need") - 1) <= p + F.col("length") - F.col("k"), F.least(p, F.col("last")))), lambda s: s.isNotNull())
    closes = F.when(F.get("at", F.size("at") - F.col("need")) >= F.col("last"), F.array("last")).otherwise(F.array().cast("array<int>"))
    starts = F.array_sort(F.array_distinct(F.concat(opens, closes)))
    return spans.withColumn("starts", starts).filter(F.size("starts") > 0).select("_row", "length", "k", "starts")


def fingerprinted(docs: DataFrame, windows: DataFrame, row: Column, text: str, id_column: str) -> DataFrame:
    """(_row, doc_id, length, start, window, print) of every window: its shingles and their fingerprint."""
    texts = docs.select(row.alias("_row"), F.col(id_column).alias("doc_id"), words_of(text).alias("w"))
    held = texts.join(F.broadcast(windows) if few(windows) else windows, "_row").withColumn("all", shingles_by(F.col("w"), F.col("k")))
    cut = held.select("_row", "doc_id", "length", "k", F.explode("starts").alias("start"), "all")
    cut = cut.select("_row", "doc_id", "length", "start", F.slice("all", F.col("start") + 1, F.col("length") - F.col("k") + 1).alias("window"))
    return cut.withColumn("print", simhash(F.col("window")))


def near_windows(printed: DataFrame, items: DataFrame) -> DataFrame:
    """(_row, length, start, _item): every window and item of one length whose fingerprints differ in RADIUS bits at most."""
    known = items.withColumn("item_print", simhash(F.col("hashes"))).select("_item", "length", "item_print", F.explode(block_keys(F.col("item_print"), ITEM_FLIPS)).alias("key"))
    asked = printed.select("_row", "length", "start", "print", F.explode(block_keys(F.col("print"), WINDOW_FLIPS)).alias("key"))
    met = asked.join(F.broadcast(known) if few(known) else known, ["length", "key"])
    return met.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("_row", "length", "start", "_item").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(_row, doc_id, item_id, start, similarity): the best window of each item in each document, where it is similar.

    _row: a hash of id and text, which tells rows of docs apart.
    """
    row = F.xxhash64(F.col(id_column), F.coalesce(F.col(text), F.lit("")))
    items = materialise(item_shingles(benchmark), "items")
    windows = materialise(windows_of(docs, items, row, text, similarity), "windows")
    printed = materialise(fingerprinted(docs, windows, row, text, id_column), "prints")
    near = materialise(near_windows(printed, items), "near")
    pairs = near.join(printed.drop("print"), ["_row", "length", "start"]).join(items.select("_item", "item_id", F.col("hashes").alias("item")), "_item")
    common = F.size(F.array_intersect(numbered(F.col("window")), numbered(F.col("item"))))
    scored = pairs.select("_row", "doc_id", "_item", "item_id", "start", common.alias("common"), (F.size("window") + F.size("item") - common).alias("total"))
    exact = scored.filter(F.col("common") >= F.col("total") * similarity - 1e-9).withColumn("similarity", F.col("common") / F.col("total"))
    best = exact.groupBy("_row", "_item").agg(F.min("doc_id").alias("doc_id"), F.min("item_id").alias("item_id"), F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
    return best.select("_row", "doc_id", "item_id", (-F.col("best.s")).alias("start"), F.col("best.similarity").alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    gone = materialise(leaks(docs, benchmark, text, id_column, **how).select("_row").distinct(), "leaks")
    row = F.xxhash64(docs[id_column], F.coalesce(docs[text], F.lit("")))
    return docs.join(F.broadcast(gone) if few(gone) else gone, row == gone["_row"], "left_anti")
