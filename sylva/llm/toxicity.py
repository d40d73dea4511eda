"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all training texts are unlabelled, whatever their labels say. A linear
classifier over the presence of letter runs and their beginnings is fitted in numpy on the risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with the logistic loss: the second part is the risk on the negatives, corrected by the class prior; where it falls
below zero the step goes the other way (Kiryo et al., 2017). The prior is the share of toxic rows among the labelled
training rows. Features are chosen by counts over all training texts. Every training text is dealt to one of several
classifiers, of Fit.bucket texts each about; each is fitted on its own texts as the unlabelled ones and on the positives,
and the weights are averaged. The positives are all confirmed ones, or a sample of them: Fit.positives is its size.

Texts alone are scored; labels, language, source and id are no inputs of a score. Nulls: a null text is empty and
gets the score of a text without features; rows with a null or missing label are unlabelled; a null id counts as the
empty string for the choice of training rows. If no toxic row may be learned from, every score is 0. Repeated rows
count each. Texts of any length are scored whole. Extra columns of either table are ignored whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.hashing import LOWER, U, mix, prefix_sums, range_hash, runs, utf8
from sylva.runtime import materialise, release

BITS = 20
RANGE = 14
#: Ids of toxic rows that are broadcast at most; more are met by a shuffle.
BROADCAST_IDS = 200_000
#: Lengths, in bytes, of the beginnings of letter runs that are features beside the whole runs.
STEMS = (4, 5, 6, 7, 8, 10)
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Fit:
    #: Confirmed toxic rows that the fit takes at most; they are sampled by a hash beyond.
    positives: int = 5_000
    #: Training texts of one classifier, about.
    bucket: int = 10_000
    features: int = 4096
    steps: int = 400
    #: Unlabelled texts, and positives, in one step.
    batch: int = 2_000
    rate: float = 0.05
    decay: float = 1e-3
    #: How far below zero the corrected risk may fall, and the weight of the step back.
    slack: float = 0.0
    back: float = 1.0


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of letter runs and their beginnings; a feature may repeat in a document."""
    letter = IS_LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (~np.concatenate(([False], letter[:-1])) | edge[:-1]))
    ends = np.flatnonzero(letter & (~np.concatenate((letter[1:], [False])) | edge[1:])) + 1
    sums = prefix_sums(raw, LOWER)
    doc = np.searchsorted(offsets, starts, "right") - 1
    found, where = [range_hash(sums, starts, ends) + U(1)], [doc]
    for n in STEMS:
        long = ends - starts >= n
        found.append(range_hash(sums, starts[long], starts[long] + n) + U(2 + n))
        where.append(doc[long])
    return (mix(np.concatenate(found)) >> U(64 - BITS)).astype(np.int64), np.concatenate(where)


def present(raw: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, document, feature) of runs of documents: each feature once for a document. chosen: number of each feature, -1 for none."""
    for a, b in runs(offsets):
        feature, doc = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        if chosen is not None:
            feature = chosen[feature]
            doc, feature = doc[feature >= 0], feature[feature >= 0]
        key = np.unique(doc << BITS | feature)
        yield a, b, key >> BITS, key & ((1 << BITS) - 1)


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, all and toxic, in ranges of features."""
    counts, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        raw, offsets = utf8(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        n += [len(toxic), toxic.sum()]
        for a, _, doc, feature in present(raw, offsets):
            counts[0] += np.bincount(feature, minlength=1 << BITS)
            counts[1] += np.bincount(feature[toxic[doc + a]], minlength=1 << BITS)
    if n[0]:
        parts = counts.astype(np.int32).reshape(2, -1, 1 << RANGE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts.shape[1]), pa.int64()), pa.array([parts[:, k].tobytes() for k in range(parts.shape[1])], pa.binary()), pa.array(np.full(parts.shape[1], n[0])), pa.array(np.full(parts.shape[1], n[1]))], names=["part", "counts", "n", "n_toxic"])


def add_up(table: pa.Table) -> pa.Table:
    total = np.zeros(2 << RANGE, np.int64)
    for x in table["counts"]:
        total += np.frombuffer(x.as_buffer(), np.int32)
    one = lambda x, t=pa.int64(): pa.array([x], t)
    return pa.table({"part": one(table["part"][0].as_py()), "counts": one(total.tobytes(), pa.binary()), "n": one(int(np.sum(table["n"].to_numpy()))), "n_toxic": one(int(np.sum(table["n_toxic"].to_numpy())))})


TALLIES = "part long, counts binary, n long, n_toxic long"


def choose(counts: np.ndarray, n: int, n_toxic: int, most: int) -> np.ndarray:
    """Number of each feature among the `most` that set toxic texts apart, else -1."""
    b = (counts[0] + 0.5) / (n + 1)
    a = counts[1] / n_toxic
    z = np.where(counts[0] > 1, np.abs(a - b) / np.sqrt(b * (1 - np.minimum(b, 1 - 1e-9)) / n_toxic + 1.0 / n_toxic**2), 0)
    best = np.argsort(-z, kind="stable")[:most]
    best = np.sort(best[z[best] > 2])
    chosen = np.full(1 << BITS, -1)
    chosen[best] = np.arange(len(best))
    return chosen


def picked(chosen):
    """Batches of (text, toxic, key) with the text replaced by the numbers of its features."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            out = []
            for a, b, doc, feature in present(raw, offsets, chosen.value):
                edges = np.searchsorted(doc, np.arange(b - a + 1))
                out += [feature[x:y].astype(np.int16).tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
            key = batch.column(2).to_numpy(zero_copy_only=False).view(U)
            order = np.argsort(key, kind="stable")  # rows that repeat get keys of their own
            heads = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            again = np.empty(len(key), U)
            again[order] = (np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key))))).astype(U)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1), pa.array((key + mix(again) * (again > 0)).view(np.int64))], names=["found", "toxic", "key"])

    return apply


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Rows:
    """Texts as lists of feature numbers, dealt into batches that take turns."""

    def __init__(self, rows: list[np.ndarray], batch: int) -> None:
        self.parts = []
        for a in range(0, max(len(rows), 1), batch):
            part = rows[a : a + batch]
            self.parts.append((np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part).astype(np.int64) if part else np.zeros(0, np.int64), max(len(part), 1)))

    def at(self, step: int) -> tuple[np.ndarray, np.ndarray, int]:
        return self.parts[step % len(self.parts)]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, n_features: int, how: Fit) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over batches."""
    positives, others = Rows(positive, how.batch), Rows(unlabelled, how.batch)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    margin = lambda x: np.bincount(x[0], w[x[1]], x[2]) + w[-1]
    slope = lambda x, g: np.append(np.bincount(x[1], g[x[0]], n_features), g.sum()) / x[2]
    for step in range(1, how.steps + 1):
        p, u = positives.at(step), others.at(step)
        fp, fu = margin(p), margin(u)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = slope(u, sigmoid(fu)) - prior * slope(p, sigmoid(fp))
        g = prior * slope(p, -sigmoid(-fp)) + g_negative if negative >= -how.slack else -how.back * g_negative
        g[:-1] += how.decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


WEIGHTS = "part long, weights binary, n long"


def fit_bucket(positives, prior: float, n_features: int, how: Fit):
    """The weights of the classifier of one bucket, times its texts."""

    def apply(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["found"].to_numpy(), table["key"].to_numpy()))  # whatever the order of arrival
        rows = [np.frombuffer(table["found"][int(i)].as_buffer(), np.int16) for i in order]
        weights, bias = fit([np.frombuffer(x, np.int16) for x in positives.value], rows, prior, n_features, how)
        return pa.table({"part": table["bucket"][:1].combine_chunks(), "weights": pa.array([(np.append(weights, bias) * len(rows)).tobytes()], pa.binary()), "n": pa.array([len(rows)], pa.int64())})

    return apply


def add_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all classifiers of a task."""
    total, n = None, 0
    for batch in batches:
        for x, k in zip(batch.column(1), batch.column(2), strict=True):
            weights = np.frombuffer(x.as_buffer())
            total, n = weights if total is None else total + weights, n + k.as_py()
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["part", "weights", "n"])


def scored(model):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights, bias = model.value
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            score = np.full(batch.num_rows, float(sigmoid(np.array(bias))))
            for a, b, doc, feature in present(raw, offsets, chosen):
                score[a:b] = sigmoid(np.bincount(doc, weights[feature], b - a) + bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    return apply


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, how: Fit = Fit(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; labels: (id_column, toxic), learned from where held_out is false."""
    spark = docs.sparkSession
    docs, labels = docs.select(id_column, text), labels.select(id_column, "toxic")
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learned = labels.filter(~held_out & F.col(id_column).isNotNull() & F.col("toxic").isNotNull())
    share = learned.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    kind = docs.schema[id_column].dataType.simpleString()
    if not share:
        return rows.select(F.col("doc_id").alias(id_column), "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    prior = min(max(share, 1e-4), 0.9)
    toxic_ids = learned.filter("toxic = 1").select(F.col(id_column).alias("_id")).distinct()
    few = toxic_ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    train = rows.filter(~F.col("held_out")).join(F.broadcast(toxic_ids) if few else toxic_ids, F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("toxic"), "doc_id")
    counts, n, n_toxic = np.zeros((2, 1 << BITS), np.int64), 0, 0
    for row in train.select("text", "toxic").mapInArrow(tally, TALLIES).groupBy("part").applyInArrow(add_up, TALLIES).toLocalIterator():  # 2**BITS counters, whatever the input is
        counts[:, row["part"] << RANGE : (row["part"] + 1) << RANGE] = np.frombuffer(row["counts"], np.int64).reshape(2, -1)
        n, n_toxic = row["n"], row["n_toxic"]
    if not n_toxic:
        return rows.select(F.col("doc_id").alias(id_column), "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    chosen = choose(counts, n, n_toxic, how.features)
    shared = spark.sparkContext.broadcast(chosen)
    found = train.select("text", "toxic", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(picked(shared), "found binary, toxic boolean, key long")
    found = materialise(found, "features")
    n_features, buckets = max(int(chosen.max()) + 1, 1), max(1, -(-n // how.bucket))
    share = min(1.0, how.positives / n_toxic)
    sample = found.filter(F.col("toxic") & (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))).select("key", "found")
    positives = spark.sparkContext.broadcast([bytes(r["found"]) for r in sample.sort("key", "found").collect()])  # about Fit.positives rows
    dealt = found.select("found", "key", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(buckets)).alias("bucket"))
    # One row for each task, then 16 in all reach the driver, however many classifiers there are.
    sums = dealt.groupBy("bucket").applyInArrow(fit_bucket(positives, prior, n_features, how), WEIGHTS).mapInArrow(add_weights, WEIGHTS)
    sums = sums.repartition(16, F.xxhash64("weights")).mapInArrow(add_weights, WEIGHTS).sort("weights").collect()
    mean = sum(np.frombuffer(r["weights"]) for r in sums) / sum(r["n"] for r in sums)
    weights, bias = mean[:-1], float(mean[-1])
    release(found)
    model = spark.sparkContext.broadcast((chosen, weights, bias))
    out = rows.mapInArrow(scored(model), f"doc_id {kind}, held_out boolean, score double")
    return out.select(F.col("doc_id").alias(id_column), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
