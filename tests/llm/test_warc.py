import base64
import gzip
import hashlib
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import warc as w
from sylva.runtime import materialise, ship


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(st.characters(min_codepoint=33, max_codepoint=1000), min_size=1, max_size=20), st.binary(max_size=300)), max_size=8), st.sampled_from([1, 2]))
def test_archives_by_declared_lengths(records, version):
    data = w.write_arc("x.arc", version, records)
    assert [(r.url, r.content, r.version, r.mime) for r in w.parse_arc(data)] == [(u, c, version, "text/html") for u, c in records]


def test_urls_with_spaces_and_bad_archives():
    head = b"filedesc://x 0.0.0.0 20240101000000 text/plain 73\n1 0 a\nURL IP-address Archive-date Content-type Archive-length\n\n          \n"
    about = b"1 0 a\nURL IP-address Archive-date Content-type Archive-length\n\n"
    head = b"filedesc://x 0.0.0.0 20240101000000 text/plain %d\n" % len(about) + about + b"\n"
    [r] = w.parse_arc(head + b"http://a b/ c 1.2.3.4 199901 text/html 2\nhi\n")
    assert r.url == "http://a b/ c" and w.iso_date(r.date) == "1999-01-01T00:00:00Z"
    for bad in (b"http://a 1.2.3.4 1999 text/html 9\nhi\n", b"a b 3\nabc\n"):
        with pytest.raises(ValueError):
            list(w.parse_arc(head + bad))
    with pytest.raises(ValueError):
        list(w.parse_arc(head.replace(b"1 0 a\n", b"9 0 a\n")))


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_identifiers_hold_the_key(key):
    assert w.key_of(f"<{w.record_id(key, 'u')}>") == key


def test_a_damaged_block_is_told():
    [r] = w.parse_arc(w.write_arc("x", 1, [("u", w.legacy_content(1, b"hello"))]))
    data = w.to_warc(r, 1, None)
    [(fields, block)] = w.parse_warc(data)
    assert fields["warc-type"] == "response" and block.endswith(b"hello")
    with pytest.raises(ValueError):
        list(w.parse_warc(data.replace(b"hello", b"jello")))
    [(plain, _)] = w.parse_warc(w.to_warc(w.ArcRecord("dns:a", "1.1.1.1", "20200101", "text/dns", b"x", 1), 1, None))
    assert plain["warc-type"] == "resource"


@pytest.mark.parametrize("limit,min_bytes", [(100_000, 0), (0, 0), (100_000, 3)])
def test_round_trip(spark, tmp_path, monkeypatch, limit, min_bytes):
    ship(spark)
    monkeypatch.setattr(w, "BROADCAST_ROWS", limit)
    same = "WARC/1.1\r\n\r\nébroken\n\n" * 50
    rows = [(1, "http://a", same), (9, "http://b c\n", same), (4, None, same), (5, "", ""), (6, "http://d", None), (7, "http://e", "ab"), (8, "http://f", "ab"), (None, "http://g", same), (10, "http://h", "x" * 300000), (9, "http://b", same)]
    path = str(tmp_path / "warc")
    w.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, materialise, min_bytes=min_bytes)
    got = w.read_warc(spark.read.format("binaryFile").load(path)).collect()
    first = {}
    for k, _, t in rows:
        b = (t or "").encode()
        if k is not None and len(b) >= min_bytes:
            first[b] = max(first.get(b, k), k)
    want = []
    for k, _, t in rows:
        b = (t or "").encode()
        revisit = b in first and first[b] != k
        want.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None))
    assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("part-*") if f.stat().st_size]
    assert files and sum(len(members(f)) for f in files) >= len(rows) + len(files)
    assert all(m.startswith(b"WARC/1.1\r\n") and len(list(w.parse_warc(m))) == 1 for f in files for m in members(f) if m)


def members(data):
    """Each gzip member of a file by itself."""
    out = []
    while data:
        one = zlib.decompressobj(47)
        out.append(one.decompress(data))
        data = one.unused_data
    return out


def test_archives_from_files(spark, tmp_path, monkeypatch):
    """Plain archives, and gzipped ones with a member a record; runs are cut, and a record of 16 MB ends in an empty member."""
    ship(spark)
    monkeypatch.setattr(w, "CHUNK_BYTES", 100)
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 1 << 25)
    (tmp_path / "in").mkdir()
    big = b"z" * ((1 << 24) + 5)
    (tmp_path / "in" / "a.arc").write_bytes(w.write_arc("a.arc", 1, [("http://a", w.legacy_content(3, b"one")), ("http://b", w.legacy_content(4, big)), ("http://n", b"HTTP/1.0 200 OK\r\n\r\none")]))
    plain = w.write_arc("b.arc", 2, [("http://c", w.legacy_content(8, b"one"))])
    cut = plain.index(b"http://c")
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(plain[:cut]) + gzip.compress(plain[cut:]))
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    w.convert(files, str(tmp_path / "out"), materialise)
    got = w.read_warc(spark.read.format("binaryFile").load(str(tmp_path / "out"))).collect()
    assert sorted(((r["url"], r["key"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)) == [("http://a", 3, 3, "revisit", 8), ("http://b", 4, len(big), "response", None), ("http://c", 8, 3, "response", None), ("http://n", None, 3, "revisit", 8)]


def test_no_pages(spark, tmp_path):
    ship(spark)
    path = str(tmp_path / "none")
    w.write_warc(spark.createDataFrame([], "page_id long, url string, html string, sha int, key int"), path, materialise)
    assert w.read_warc(spark.read.format("binaryFile").load(path)).count() == 0


def test_members_are_unzipped_once_each(monkeypatch):
    """Bytes given to the decompressor follow the archive's size; the rest of the archive was copied for every member."""
    r = np.random.default_rng(2)
    plain = [r.bytes(int(n)) for n in [*r.integers(0, 3000, 300), 3 << 20]] + [b"", b"z" * (5 << 20)]
    data = b"".join(gzip.compress(x, 1, mtime=0) for x in plain) + b"\0" * 5
    passed = []

    class Counted:
        def __init__(self, bits):
            self.own = zlib.decompressobj(bits)

        def decompress(self, piece, *most):
            passed.append(len(piece))
            return self.own.decompress(piece, *most)

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(w, "zlib", SimpleNamespace(decompressobj=Counted), raising=False)
    assert w.unzipped(data) == gzip.decompress(data) == b"".join(plain)
    assert sum(passed) < 3 * len(data)
    assert w.unzipped(b"WARC/1.1") == b"WARC/1.1" and w.unzipped(b"") == b""
    with pytest.raises(EOFError):
        w.unzipped(data[:-50])
