import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, decoders

from sylva.llm import sentencepiece_codec as sc
from sylva.llm import token_counts as tc
from sylva.llm.protobuf import Model, Piece, read_model
from sylva.runtime import ship

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "  a", "▁x ▁▁", "a\n b\n\n", "<s> </s> <unk> <0x0A>", "\x00a\t\x0b", "né ñ 梦 \U0001f600", "word " * 300, " " * 100, "a" * 5000, "x" + " " * 17 + "y", "Hello, World!\r\n", "<|endoftext|>", "é" * 3]
ALPHABET = st.sampled_from([" ", "  ", "▁", "\n", "a", "the", "ing", "é", "梦", "\U0001f600", "<s>", "\t", "Z"])
library = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_counts_are_the_librarys(text):
    assert tc.counter(MODEL)(text) == len(library.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_codec_agrees_and_undoes(text):
    codec = sc.codec(MODEL, 2)
    [ids], [agree] = codec.encode([text])
    assert ids == library.encode(text) and agree
    assert codec.decode([ids])[0] == text.replace("▁", " ")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_json_vocabularies(name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    for text in TEXTS:
        assert tc.counter(path)(text) == len(whole.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["x" + " " * 17 + "y", " " * 100, "a\n" + " " * 39 + "b c", "▁" * 16 + "the"])
def test_texts_with_long_runs_are_compared(text, monkeypatch):
    codec = sc.Codec(MODEL, 2)
    assert codec.own_ids([text]) == [library.encode(text)]
    monkeypatch.setattr(codec, "own_ids", lambda texts: [[0]] * len(texts))
    assert codec.encode([text]) == ([library.encode(text)], [False])


def test_the_backend_gives_ids_and_texts(monkeypatch):
    codec = sc.Codec(MODEL, 2)
    mine = codec.own_ids(["some words"])
    monkeypatch.setattr(codec, "own_ids", lambda texts: mine)
    [ids], [agree] = codec.encode(["some words"])
    assert ids is mine[0] and agree
    codec.core.decoder = codec.quick.decoder = decoders.Fuse()
    assert codec.decode([ids]) == ["▁some▁words"]


def test_texts_without_runs_go_line_by_line_and_each_text_once(monkeypatch):
    codec = sc.Codec(MODEL, 2)
    assert codec.quick.token_to_id(" the") == codec.core.token_to_id("▁the") == library.piece_to_id("▁the")
    assert [cut for cut, _ in codec.quick.pre_tokenizer.pre_tokenize_str("a b\n\nc")] == ["a b\n", "\n", "c"]
    r = random.Random(7)
    words = ["the", "ing", "é", "梦", "\U0001f600", "<s>", "<0x0A>", "a\n", "\n", "\n b", "\t", "\x00", "\r\n", "Hello,"]
    plain = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(300)] + [""]
    plain = [t for t in plain if "  " not in t]
    seen = []
    encode = codec.quick.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return encode(texts, **options)

    monkeypatch.setattr(codec, "quick", Counted())
    mixed = [x for t in plain for x in (t, f" {t}  ▁x")]
    ids, agree, packed = codec.encode_packed(mixed)
    assert ids == library.encode(mixed) and all(agree) and seen == plain
    assert packed == [struct.pack(f"<{len(i)}i", *i) for i in ids]


def test_packed_ids_are_the_librarys_where_the_two_differ(monkeypatch):
    codec = sc.Codec(MODEL, 2)
    monkeypatch.setattr(codec, "own_ids", lambda texts: [[0], library.encode(texts[1])])
    ids, agree, packed = codec.encode_packed(["some words", "more"])
    assert agree == [False, True] and ids == library.encode(["some words", "more"])
    assert packed == [struct.pack(f"<{len(i)}i", *i) for i in ids]


def test_unsafe_cuts_are_told():
    model = read_model(open(MODEL, "rb").read())
    assert tc.cuts_are_safe(model) and len(model.pieces) == 32000 and model.byte_fallback
    model.pieces.append(Piece("a▁b", 0.0, Model.NORMAL))
    assert not tc.cuts_are_safe(model)


def message(number, value):
    """A field of the wire format: a varint, a float, or bytes."""

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def unigram_model():
    """A unigram model with byte fallback: words and letters with scores made by hand, no training."""
    words = ["▁the", "▁a", "▁an", "▁and", "nd", "the", "er", "▁ther", "ing", "▁s", "▁si", "▁sing", "sing", "n", "g"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    pieces += [(w, -2.0 - 0.37 * i, 1) for i, w in enumerate(words)] + [(c, -9.0 - 0.11 * i, 1) for i, c in enumerate("▁abcdefhilmorst")]
    body = b"".join(message(1, message(1, t.encode()) + message(2, s) + message(3, k)) for t, s, k in pieces)
    trainer = b"".join(message(n, v) for n, v in ((3, 1), (35, 1), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1)))
    normaliser = message(1, b"identity") + message(3, 1) + message(4, 0) + message(5, 1)
    return body + message(2, trainer) + message(3, normaliser)


def test_unigram_models_are_rebuilt(tmp_path):
    (tmp_path / "own.model").write_bytes(unigram_model())
    codec = sc.Codec(str(tmp_path / "own.model"), 2)
    r = random.Random(5)
    parts = ["the", "and", "sing", "er", "thering", "Z", "é", "梦", "\U0001f600", "a", "an", "q\n", "x y"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(1, 400))) for _ in range(60)] + ["", "a", " the  and"]
    ids, agree = codec.encode(texts)
    assert all(agree) and ids == codec.library.encode(texts) and codec.decode(ids) == texts
    assert codec.model_kind == Model.UNIGRAM and sum(3 <= i < 259 for x in ids for i in x) > 100


def test_tables(spark):
    ship(spark)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "null id"), (0, "again")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tc.token_counts(df, "piece_bpe_32k.model").collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows), key=str)
    trip = sc.round_trip(df).collect()
    assert len(trip) == len(rows) and all(r["parity"] and r["round_trip"] for r in trip)
    back = sc.decode_texts(sc.encode_texts(df.withColumnsRenamed({"n_tokens": "token_ids"}).withColumn("parity", df["doc_id"]).withColumn("decoded", df["doc_id"]))).collect()
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") and r["parity"] and r["token_ids"] == library.encode(r["text"] or "") for r in back)
    assert tc.token_counts(df.limit(0), "piece_bpe_32k.model").count() == 0 and sc.round_trip(df.limit(0)).count() == 0


def test_long_texts_and_clashing_names(spark):
    ship(spark)
    long = "words of a long text, é梦\n" * 20_000
    df = spark.createDataFrame([(1, long, 1, "x", True)], "doc_id long, text string, n_tokens int, n_bytes string, parity boolean")
    [r] = tc.token_counts(df, "piece_bpe_32k.model").collect()
    assert (r["n_bytes"], r["n_tokens"]) == (len(long.encode()), len(library.encode(long)))
    [r] = sc.round_trip(df).collect()
    assert r["n_tokens"] == len(library.encode(long)) and r["parity"] and r["round_trip"]
