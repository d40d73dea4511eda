"""Token counts without encoding whole texts: pre-tokens that are proven to be one token are counted by lookup.

A tokenizer cuts a text into pre-tokens that no merge crosses, so a text has as many tokens as its pre-tokens
together. Two facts are proven offline, from the vocabulary alone, before any text is read:

* no vocabulary string crosses a cut (for sentencepiece models no piece holds a word character before the space
  mark, and none holds a line feed);
* which vocabulary strings the library encodes, alone, as exactly one token. These are the shortcut table.

Pre-tokens in the table count one. Only the rest goes through the library's merges, once per distinct string.
If the first proof fails for a model, whole texts are encoded instead.

Nulls and empty texts have no tokens. Texts of any length are counted whole. Extra columns are ignored whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.protobuf import Model, read_model

#: Strings kept in one worker's memory of merged pre-tokens before it is emptied.
MEMORY = 400_000
#: Longer pre-tokens are merged each time and not kept.
LONGEST_KEPT = 64
MARK = "▁"


class Merged(dict):
    """Token count of a pre-token: the shortcut table first, then what the library's merges give."""

    def __init__(self, proven: Iterable[str], merge: Callable[[str], int]) -> None:
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.merge = frozenset(self), merge

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) - len(self.proven) >= MEMORY:
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
            self[piece] = n
        return n


def cuts_are_safe(model: Model) -> bool:
    """No piece reaches over a cut, the text isn't rewritten first, and no user-defined string is matched in it."""
    pieces = [p.text for p in model.pieces if p.kind == Model.NORMAL]
    return (
        model.kind == Model.BPE
        and not model.charsmap
        and not model.remove_extra_whitespaces
        and model.escape_whitespaces
        and not model.whitespace_as_suffix
        and not any(p.kind == Model.USER_DEFINED for p in model.pieces)
        and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
    )


def sentencepiece_counter(path: str) -> Callable[[str], int]:
    import sentencepiece

    with open(path, "rb") as file:
        data = file.read()
    model = read_model(data)
    whole = sentencepiece.SentencePieceProcessor(model_proto=data)
    if not cuts_are_safe(model):
        return lambda text: len(whole.encode(text))
    # A later normalizer_spec message is merged into the first: the same model without the leading space.
    alone = sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a\x02\x18\x00")
    strings = [p.text for p in model.pieces if p.kind == Model.NORMAL]
    counts = Merged((s for s, ids in zip(strings, alone.encode(strings), strict=True) if len(ids) == 1), lambda s: len(alone.encode(s)))
    # Runs of spaces go with the word after them; a line feed stands alone, as a byte.
    cut = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+").findall
    first = MARK if model.add_dummy_prefix else ""
    look = counts.__getitem__
    return lambda text: sum(map(look, cut(first + text.replace(" ", MARK)))) if text else 0


def tokenizers_counter(path: str) -> Callable[[str], int]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    if library.pre_tokenizer is None or any(not t.special for t in library.get_added_tokens_decoder().values()):
        return lambda text: len(library.encode(text, add_special_tokens=False).ids)
    model, cut, normalise = library.model, library.pre_tokenizer.pre_tokenize_str, library.normalizer
    special = re.compile("|".join(re.escape(t.content) for t in library.get_added_tokens_decoder().values()) or r"(?!)")
    strings = list(library.get_vocab(with_added_tokens=False))
    counts = Merged((s for s in strings if len(model.tokenize(s)) == 1), lambda s: len(model.tokenize(s)))

    def count(text: str) -> int:
        if special.search(text) is not None:  # the library's own handling of these strings
            return len(library.encode(text, add_special_tokens=False).ids)
        if normalise is not None:
            text = normalise.normalize_str(text)
        return sum(counts[piece] for piece, _ in cut(text))

    return count


_COUNTERS: dict[str, Callable[[str], int]] = {}


def counter(path: str) -> Callable[[str], int]:
    """The counting function of a vocabulary file, made once per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = sentencepiece_counter(path) if path.endswith(".model") else tokenizers_counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id_column, n_bytes, n_tokens) of every row of docs under the tokenizer file vocabulary.

    vocabulary: the bare name of a file of public_tokenizers, found on each worker, or a path that each worker has.
    The input is read once, without a shuffle. Rows that repeat are counted each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = counter(resolve(vocabulary))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([tokens_of(t) if t else 0 for t in texts], pa.int64())], names=[id_column, "n_bytes", "n_tokens"]
            )

    narrow = docs.select(id_column, F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(count, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long")


def resolve(vocabulary: str) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)
