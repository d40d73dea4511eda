"""SentencePiece encoding and decoding by the tokenizers library.

The model file's protocol buffer is parsed here and rebuilt as a tokenizers pipeline: the normaliser (character map,
extra spaces, leading mark, spaces to marks), pieces with their scores (unigram) or merges ordered by score (BPE),
byte fallback, and the decoder that undoes it all. Texts are encoded in batches on several threads.

The ids and the decoded texts are this backend's: whole texts go through its normaliser, pre-tokenizer, merges and
decoder. Only pre-tokens that begin with a run of marks, whose merges tie in the model, are merged here in
sentencepiece's order, which the tokenizers library lacks.

Parity is verified against the sentencepiece library for every text; where the two differ, the library's ids are
returned and the row says so.

Nulls and empty texts have no ids. Decoding gives back the text, but for U+2581, which the model can't tell from a
space. A text of any length is encoded whole, a longer one than BATCH_BYTES in a call of its own. Repeated rows count
each. Extra columns are kept by encode_texts() and decode_texts(), which replace those that have the name of a result;
round_trip() returns the id and its results only. Empty tables work.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sylva.llm.protobuf import Model, read_model
from sylva.llm.token_counts import MARK, cuts_are_safe, resolve
from sylva.runtime import give_back

#: Texts encoded in one call, by bytes.
BATCH_BYTES = 1 << 18
#: What begins with a run of marks, up to the next mark or line feed. No merge crosses its ends in a model that cuts_are_safe() accepts.
RUN = f"{MARK}{{2,}}[^{MARK}\n]*"


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, the best score first; among equal scores by the order of pieces."""
    score = {p.text: p.score for p in model.pieces if p.kind in (Model.NORMAL, Model.USER_DEFINED)}
    rank = {t: i for i, t in enumerate(score)}
    found = [(-score[t], rank[t[:i]], rank[t[i:]], t[:i], t[i:]) for t in score for i in range(1, len(t)) if t[:i] in score and t[i:] in score]
    return [m[3:] for m in sorted(found)]


def backend(model: Model):
    """(general, quick): tokenizers pipelines that do what the model says, with the same pieces and merges.

    general cuts runs of marks off, with what they lead to. quick is for texts without runs or marks: its pieces hold spaces
    where the model's hold marks, so that spaces need no rewriting, and it merges line by line, as no merge crosses a line
    feed. It gives the same ids, and is None for models that cuts_are_safe() doesn't accept.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    def bpe(space: str) -> Tokenizer:
        vocabulary = {p.text.replace(MARK, space): i for i, p in enumerate(model.pieces)}
        pairs = merges if space == MARK else [(a.replace(MARK, space), b.replace(MARK, space)) for a, b in merges]
        unknown = model.pieces[model.unk_id].text.replace(MARK, space)
        return Tokenizer(models.BPE(vocabulary, pairs, unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback))

    if model.kind == Model.BPE:
        merges = merges_of(model)
        core = bpe(MARK)
    elif model.kind == Model.UNIGRAM:
        core = Tokenizer(models.Unigram([(p.text, p.score) for p in model.pieces], model.unk_id, model.byte_fallback))
    else:
        raise ValueError("only BPE and unigram models can be rebuilt")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        core.normalizer = normalizers.Sequence(steps)
    undo = [decoders.ByteFallback(), decoders.Fuse(), decoders.Metaspace(MARK, "never")]
    if model.add_dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    core.decoder = decoders.Sequence(undo)
    if not cuts_are_safe(model) or any(" " in p.text for p in model.pieces):
        return core, None
    core.pre_tokenizer = pre_tokenizers.Split(Regex(RUN), "isolated")
    quick = bpe(" ")
    if model.add_dummy_prefix:
        quick.normalizer = normalizers.Prepend(" ")
    quick.pre_tokenizer = pre_tokenizers.Split("\n", "merged_with_previous")
    return core, quick


def by_score(model: Model):
    """Ids of a text by sentencepiece's own order of BPE merges: the best score first, among equal scores the leftmost."""
    place = {p.text: i for i, p in enumerate(model.pieces) if p.kind == Model.NORMAL}
    score = {t: model.pieces[i].score for t, i in place.items()}
    byte = {int(p.text[1:-1], 16): i for i, p in enumerate(model.pieces) if p.kind == Model.BYTE}

    def ids(text: str) -> list[int]:
        parts, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (made := parts[a] + parts[b]) in score:
                heappush(heap, (-score[made], a, b, len(made)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heappop(heap)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue  # one of the two has been merged since
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        for part in filter(None, parts):
            if part in place:
                out.append(place[part])
            elif model.byte_fallback:
                out += [byte[x] for x in part.encode()]
            elif out[-1:] != [model.unk_id]:
                out.append(model.unk_id)
        return out

    return ids


class Codec:
    """Both libraries on one model file, made once per worker process."""

    def __init__(self, path: str, threads: int) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        self.threads = threads
        model = read_model(data)
        self.model_kind = model.kind
        self.core, self.quick = backend(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tied = by_score(model) if self.quick else None

    def own_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids by the backend, of whole texts on several threads."""
        if self.quick is None:
            return [e.ids for e in self.core.encode_batch_fast(texts, add_special_tokens=False)]
        runs = ["  " in t or MARK in t or t[:1] == " " for t in texts]
        encoded = iter(self.quick.encode_batch_fast([t for t, run in zip(texts, runs, strict=True) if not run], add_special_tokens=False))
        return [self.with_runs(t) if run else next(encoded).ids for t, run in zip(texts, runs, strict=True)]

    def with_runs(self, text: str) -> list[int]:
        """The backend's ids, but for pre-tokens that begin with a run of marks: their merges tie, and go in the model's order."""
        [encoded] = self.core.encode_batch([text], add_special_tokens=False)
        cuts = self.core.pre_tokenizer.pre_tokenize_str(self.core.normalizer.normalize_str(text))
        out: list[int] = []
        for word, tokens in groupby(zip(encoded.word_ids, encoded.ids, strict=True), itemgetter(0)):
            cut = cuts[word][0]
            out += self.tied(cut) if cut.startswith(MARK * 2) else [i for _, i in tokens]
        return out

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """(ids, whether the backend agreed with the library) of each text: the backend's ids, or the library's where they differ."""
        ids, agree, _ = self.encode_packed(texts)
        return ids, agree

    def encode_packed(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bytes]]:
        """What encode() gives, and the ids of each text as 32-bit little-endian numbers."""
        theirs = self.library.encode(texts, num_threads=self.threads, return_type="numpy")
        ids = self.own_ids(texts)
        packed = [struct.pack(f"<{len(i)}i", *i) for i in ids]
        expected = [b.astype("<i4", copy=False).tobytes() for b in theirs]
        agree = [a == b for a, b in zip(packed, expected, strict=True)]
        for k, same in enumerate(agree):
            if not same:
                ids[k], packed[k] = theirs[k].tolist(), expected[k]
        return ids, agree, packed

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids, by the backend's decoder."""
        return self.core.decode_batch(ids, skip_special_tokens=False)


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int) -> Codec:
    if (path, threads) not in _CODECS:
        _CODECS[path, threads] = Codec(path, threads)
    return _CODECS[path, threads]


def lengths(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_BYTES:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def encode_texts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", text: str = "text", threads: int = 2) -> DataFrame:
    """docs with token_ids array<int> and parity boolean added. No shuffle."""
    docs = docs.drop("token_ids", "parity")
    names = docs.columns
    at = names.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(resolve(vocabulary), threads)
        for batch in batches:
            for a, b in portions(lengths(batch.column(at))):
                part = batch.slice(a, b - a)
                ids, agree, packed = both.encode_packed([t or "" for t in part.column(at).to_pylist()])
                flat = np.frombuffer(b"".join(packed), "<i4").astype(np.int32, copy=False)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(agree, pa.bool_())], names=[*names, "token_ids", "parity"])
        give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(apply, f"{kinds}, token_ids array<int>, parity boolean")


def decode_texts(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model", ids: str = "token_ids", threads: int = 2) -> DataFrame:
    """encoded with decoded string added: the text of its ids."""
    encoded = encoded.drop("decoded")
    names = encoded.columns
    at = names.index(ids)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(resolve(vocabulary), threads)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(both.decode([i or [] for i in part.column(at).to_pylist()]), pa.string())], names=[*names, "decoded"])
        give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(apply, f"{kinds}, decoded string")


def round_trip(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", text: str = "text", id_column: str = "doc_id", threads: int = 2) -> DataFrame:
    """(id, n_tokens, parity, round_trip, ids_crc32) of each row: encoded, decoded and compared in one pass of one worker.

    ids_crc32: of the ids as 32-bit little-endian numbers.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(resolve(vocabulary), threads)
        for batch in batches:
            for a, b in portions(lengths(batch.column(1))):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, agree, packed = both.encode_packed(texts)
                same = [x == t.replace(MARK, " ") for x, t in zip(both.decode(ids), texts, strict=True)]
                sums = [zlib.crc32(p) for p in packed]
                columns = [pa.array([len(i) for i in ids], pa.int64()), pa.array(agree, pa.bool_()), pa.array(same, pa.bool_()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=[id_column, "n_tokens", "parity", "round_trip", "ids_crc32"])
        give_back()

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(apply, f"`{id_column}` {kind}, n_tokens long, parity boolean, round_trip boolean, ids_crc32 long")
