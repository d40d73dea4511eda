"""Reading of sentencepiece's model file, a protocol buffer, by its public message layout."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: int


@dataclass
class Model:
    """What the encoder needs: pieces with scores and kinds, trainer and normaliser settings at their defaults."""

    # ModelProto.SentencePiece.Type, TrainerSpec.ModelType
    NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
    UNIGRAM, BPE = 1, 2

    pieces: list[Piece] = field(default_factory=list)
    kind: int = 1
    byte_fallback: bool = False
    unk_id: int = 0
    whitespace_as_suffix: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in the wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
            continue
        if wire == 2:
            size = varint()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
        else:
            raise ValueError(f"wire type {wire} is not part of a sentencepiece model")
        yield number, data[at : at + size]
        at += size


def read_model(data: bytes) -> Model:
    """Parse a ModelProto. Field numbers are those of sentencepiece_model.proto."""
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            model.pieces.append(Piece(piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, Model.NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            model.kind = spec.get(3, model.kind)
            model.byte_fallback = bool(spec.get(35, model.byte_fallback))
            model.unk_id = spec.get(40, model.unk_id)
            model.whitespace_as_suffix = bool(spec.get(24, model.whitespace_as_suffix))
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, model.charsmap)
            model.add_dummy_prefix = bool(spec.get(3, model.add_dummy_prefix))
            model.remove_extra_whitespaces = bool(spec.get(4, model.remove_extra_whitespaces))
            model.escape_whitespaces = bool(spec.get(5, model.escape_whitespaces))
    return model
