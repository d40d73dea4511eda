"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered whole, encoded once, and the character spans of its turns are intersected with those of
the tokens by binary search. The three marks of the template are added to the tokenizer as tokens of their own, so
no token reaches over the border of a turn and the mask is exact. Marks inside texts or roles are escaped: a
backslash is doubled, and a mark gets one after its first character.

Turns are ordered by turn, then role, then text (ties and repeated rows are kept). Null texts and roles are empty;
a null conversation id is a conversation. Texts of any length are formatted whole, and extra columns are ignored whatever
their names. An empty table gives an empty result. A conversation is one output row, so its turns meet in one task;
conversations are spread by their id.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.token_counts import resolve

OPEN, SAY, CLOSE = MARKS = ("<turn>", "<text>", "</turn>")
FORM = re.compile(f"{OPEN}(.*?){SAY}(.*?){CLOSE}\n", re.DOTALL)
#: Conversations encoded in one call.
BATCH = 256


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for mark in MARKS:
        text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[dict], learn: frozenset[str]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and the sorted starts and ends of the texts that are learned."""
    out, at, starts, ends = [], 0, [], []
    for turn in turns:
        head, text = f"{OPEN}{escape(turn['role'] or '')}{SAY}", escape(turn["text"] or "")
        if turn["role"] in learn:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(text))
        out += [head, text, f"{CLOSE}\n"]
        at += len(head) + len(text) + len(CLOSE) + 1
    return "".join(out), starts, ends


def loss_mask(token_starts: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """Tokens that begin inside one of the spans; both are sorted, so each border is one binary search."""
    mask = np.zeros(len(token_starts), bool)
    for a, b in zip(np.searchsorted(token_starts, starts), np.searchsorted(token_starts, ends), strict=True):
        mask[a:b] = True
    return mask


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        from tokenizers import AddedToken, Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True  # the vocabulary's own special strings are ordinary text
        library.add_tokens([AddedToken(m, special=False, normalized=False) for m in MARKS])
        _ENCODERS[path] = library
    return _ENCODERS[path]


OUTPUT = "formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_chats(turns: DataFrame, vocabulary: str = "byte_bpe_50k.json", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, token_ids, token_starts, token_ends, loss_mask) of each conversation of (conv_id, turn, role, text)."""
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    roles = frozenset(learn)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(resolve(vocabulary))
        for big in batches:
            for first in range(0, big.num_rows, BATCH):
                batch = big.slice(first, BATCH)
                made = [render(t, roles) for t in batch.column(1).to_pylist()]
                encoded = library.encode_batch([m[0] for m in made], add_special_tokens=False)
                spans = [np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * len(e)).reshape(-1, 2) for e in encoded]
                masks = [loss_mask(s[:, 0], m[1], m[2]) for s, m in zip(spans, made, strict=True)]
                edges = pa.array(np.append(0, np.cumsum([len(e) for e in encoded])), pa.int32())
                listed = lambda x, edges=edges: pa.ListArray.from_arrays(edges, pa.array(x))
                flat = np.concatenate(spans)
                ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int32, len(flat))
                columns = [pa.array([m[0] for m in made], pa.string()), listed(ids), listed(flat[:, 0]), listed(flat[:, 1]), listed(np.concatenate(masks))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"])

    return whole.mapInArrow(apply, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {OUTPUT}")


def read_chats(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns parsed from the template, and the text that the mask's tokens cover."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            starts, ends, mask = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            edges = np.append(0, np.cumsum([len(x) for x in batch.column(2)]))
            for text, a, b in zip(batch.column(1).to_pylist(), edges[:-1], edges[1:], strict=True):
                told, n = hashlib.sha256(), 0
                for role, said in FORM.findall(text):
                    told.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                    n += 1
                # Learned tokens that follow each other cover one piece of the text.
                turn = np.flatnonzero(np.diff(mask[a:b].astype(np.int8), prepend=0, append=0)) + a
                loss = unescape("".join(text[starts[x] : ends[x:y].max()] for x, y in zip(turn[::2], turn[1::2], strict=True)))
                rows.append((n, told.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(apply, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
