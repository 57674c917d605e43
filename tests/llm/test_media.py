"""TIFF pages and the web archive."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corploom.llm import tiff, warc


@given(st.binary(max_size=2000) | st.text(alphabet="ab", max_size=9000).map(str.encode))
def test_codecs_round_trip(raw):
    assert tiff.packbits_decode(tiff.packbits_encode(raw)) == raw
    assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw


def test_published_codec_examples():
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa")
    assert tiff.packbits_decode(packed).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"
    assert tiff.packbits_decode(b"\x80\x00x") == b"x"  # 128 is no operation


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_of_any_layout(compression, order, tile):
    rng = np.random.default_rng(1)
    for dtype in (np.uint8, np.uint16, np.uint32):
        for predictor in (1, 2):
            pages = [rng.integers(0, np.iinfo(dtype).max, (37, 45), dtype=dtype), rng.integers(0, 9, (5, 64), dtype=dtype), np.zeros((1, 1), dtype)]
            found = list(tiff.read_pages(tiff.write_tiff(pages, tiff.Layout(compression, predictor, 7, tile, order))))
            assert [(p.height, p.width, p.pixels) for p in found] == [(*p.shape, p.tobytes()) for p in pages]


def hand_made(entries, data, order="<"):
    """A classic TIFF of one directory after its data."""
    at = 8 + len(data)
    raw = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + data
    raw += struct.pack(order + "H", len(entries))
    for tag, kind, count, value in entries:
        raw += struct.pack(order + "HHI", tag, kind, count) + struct.pack(order + "I", value)
    return raw + struct.pack(order + "I", 0)


def test_planes_samples_float_prediction_and_big_tiff():
    # Two samples a pixel, stored plane after plane.
    tags = [(256, 4, 1, 2), (257, 4, 1, 1), (258, 3, 2, 0x00080008), (259, 4, 1, 1), (273, 4, 2, 8), (277, 4, 1, 2), (278, 4, 1, 1), (279, 4, 2, 16), (284, 4, 1, 2)]
    planar = hand_made(tags, struct.pack("<4I", 24, 26, 2, 2) + b"abcd")
    assert [p.pixels for p in tiff.read_pages(planar)] == [b"acbd"]
    values = np.array([[1.5, -2.0, 3.25]], "<f4")
    shuffled = values.view(np.uint8).reshape(1, 3, 4)[:, :, ::-1].transpose(0, 2, 1).reshape(1, -1)
    stored = np.diff(shuffled, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    tags = [(256, 4, 1, 3), (257, 4, 1, 1), (258, 4, 1, 32), (259, 4, 1, 1), (273, 4, 1, 8), (278, 4, 1, 1), (279, 4, 1, 12), (317, 4, 1, 3)]
    assert [p.pixels for p in tiff.read_pages(hand_made(tags, stored))] == [values.tobytes()]
    big = b"MM" + struct.pack(">HHHQ", 43, 8, 0, 24) + b"xy" + b"\0" * 6 + struct.pack(">Q", 6)
    for tag, value in ((256, 2), (257, 1), (258, 8), (259, 1), (273, 16), (279, 2)):
        big += struct.pack(">HHQHHI", tag, 3, 1, value, 0, 0)
    assert [p.pixels for p in tiff.read_pages(big + struct.pack(">Q", 0))] == [b"xy"]


def test_damaged_media_say_why(spark, odd_docs, odd_rows, no_docs):
    good = tiff.write_tiff([np.zeros((2, 2), np.uint8)], tiff.Layout())
    link = struct.unpack_from("<I", good, 4)[0]
    cycle = good[:-4] + struct.pack("<I", link)
    rows = [(1, good), (2, None), (3, b""), (4, b"GIF89a.."), (5, good[:-9]), (6, cycle), (7, good.replace(b"x", b"y")[:8] + b"\xff" * 8 + good[16:]), (8, good[:4] + bytes(4) + good[8:])]

    def changed(tag, value, raw=None):
        raw = bytearray(raw or tiff.write_tiff([np.ones((40, 40), np.uint8)], tiff.Layout(tile=(16, 32))))
        at = raw.index(struct.pack("<HHI", tag, 4, 1)) + 8
        raw[at : at + 4] = struct.pack("<I", value)
        return bytes(raw)

    rows += [(9, changed(322, 0)), (10, changed(323, 0)), (11, changed(256, 1 << 31)), (12, changed(257, 1 << 30)), (13, changed(277, 0)), (14, changed(258, 7)), (15, changed(259, 99))]
    two = tiff.write_tiff([np.zeros((64, 64), np.uint8), np.ones((3, 3), np.uint8)], tiff.Layout(tiff.NONE))
    rows += [(16, changed(259, 99, two))]
    df = spark.createDataFrame(rows, "k long, media binary")
    found = {}
    for r in tiff.decode_pages(df, keep=("k",)).collect():
        found.setdefault(r.k, []).append((r.page, r.n_pages, r.error is None, r.pixels is None))
    assert found[1] == [(0, 1, True, False)]
    assert all(found[k] == [(-1, 0, False, True)] for k in (2, 3, 4, 5, 8))
    assert found[6] == [(-1, 1, False, True), (0, 1, True, False)] and found[7] == [(0, 1, False, True)]
    assert all(found[k] == [(0, 1, False, True)] for k in range(9, 16))
    assert found[16] == [(0, 2, False, True), (1, 2, True, False)]
    media = df.selectExpr("k AS doc_id", "1L AS n_bytes", "media")
    features = {r.doc_id: r for r in tiff.page_features(tiff.decode_pages(media, keep=("doc_id", "n_bytes"))).collect()}
    assert sorted(features) == list(range(1, 17)) and features[1].payload_bytes == 4
    assert all(features[k].feature.startswith("error=") and features[k].payload_sha256 is None for k in range(2, 17))


@given(st.binary(max_size=300), st.integers(0, 400), st.integers(0, 255))
def test_any_bytes_are_pages_or_errors(noise, at, value):
    raw = bytearray(tiff.write_tiff([np.arange(64, dtype=np.uint8).reshape(8, 8)], tiff.Layout(tiff.LZW)))
    raw[at % len(raw)] = value
    for media in (bytes(raw), b"II*\0" + noise, noise):
        pages, wrong = tiff.walk_pages(media)
        assert pages or wrong


def test_an_inflated_strip_is_not_expanded():
    bomb = zlib.compress(bytes(50_000_000), 9)
    tags = [(256, 4, 1, 2), (257, 4, 1, 1), (258, 4, 1, 8), (259, 4, 1, 8), (273, 4, 1, 8), (278, 4, 1, 1), (279, 4, 1, len(bomb))]
    assert [p.pixels for p in tiff.read_pages(hand_made(tags, bomb + b"\0" * (len(bomb) % 2)))] == [b"\0\0"]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_samples_below_a_byte(depth):
    rng = np.random.default_rng(depth)
    image = rng.integers(0, 1 << depth, (5, 13), dtype=np.uint8)
    bits = np.unpackbits(image[:, :, None], axis=2)[:, :, 8 - depth :].reshape(5, -1)
    packed = tiff.packbits_encode(np.packbits(bits, axis=1).tobytes())
    tags = [(256, 4, 1, 13), (257, 4, 1, 5), (258, 3, 1, depth), (259, 3, 1, 32773), (273, 4, 1, 8), (278, 4, 1, 5), (279, 4, 1, len(packed))]
    (page,) = tiff.read_pages(hand_made(tags, packed + b"\0" * (len(packed) % 2)))
    assert page.pixels == image.tobytes() and page.bits == depth


def test_long_lzw_streams():
    rng = np.random.default_rng(1)
    for raw in (rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes(), b"a" * 300_000, bytes(rng.integers(97, 101, 90_000, dtype=np.uint8))):
        packed = tiff.lzw_encode(raw)
        assert tiff.lzw_decode(packed) == raw and tiff.lzw_decode(packed, 1000)[:1000] == raw[:1000] and len(tiff.lzw_decode(packed, 1000)) < 6000


def test_texts_survive_storage(odd_docs, odd_rows, no_docs):
    got = sorted((tuple(r) for r in tiff.page_features(tiff.decode_pages(tiff.store_texts(odd_docs), keep=("doc_id", "n_bytes"))).collect()), key=str)
    expected = []
    for i, t, *_ in odd_rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = tiff.store_payload(raw, tiff.PayloadParameters())
        expected.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert [g[:7] for g in got] == sorted(expected, key=lambda e: str((*e, next(g[7] for g in got if g[:7] == e))))
    assert len({(g[6], g[7]) for g in got}) == len({g[6] for g in got})
    assert tiff.page_features(tiff.decode_pages(tiff.store_texts(no_docs), keep=("doc_id", "n_bytes"))).count() == 0
    small = tiff.PayloadParameters(page_rows=4)
    assert tiff.decode_pages(tiff.store_texts(odd_docs.where("doc_id = 209"), small), keep=("doc_id",)).count() == -(-70_000 // 256)


def test_the_archive_gives_records_back(spark):
    html = ["a", None, "", "b\r\n\r\nWARC/1.0", "é" * 5000]
    rows = [(i, None if i % 7 == 3 else f"http://x/{i}\r\nInjected: 1", html[i % 5]) for i in range(60)] + [(2, "http://again", ""), (2, "http://again", ""), (None, None, "only null"), (None, "u", "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS stored").repartition(4)
    for least in (0, 2):
        archive = warc.write_archive(df, least_bytes=least)
        got = warc.read_archive(archive).collect()
        assert len(got) == len(rows)
        by_payload = {}
        for i, _, h in rows:
            by_payload.setdefault((h or "").encode(), []).append(i)
        for raw, ids in by_payload.items():
            sha1 = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            mine = [r for r in got if r.payload_digest == sha1]
            assert len(mine) == len(ids) and all(r.payload_bytes == len(raw) for r in mine)
            first = min((i for i in ids if i is not None), default=None)
            answers = [r for r in mine if r.record_type == "response"]
            if len(raw) < least:
                assert len(answers) == len(ids)
            else:
                assert [r.page_id for r in answers] == [first] and all(r.refers_to == first for r in mine if r.record_type == "revisit")
        assert archive.payloads.count() == len(by_payload)
    record = next(r.record for r in warc.responses(archive).where("page_id = 4").collect())
    fields, payload = warc.parse_record(bytes(record))
    assert payload == ("é" * 5000).encode() and "Injected" not in fields and fields["WARC-Type"] == "response" and fields["http"].startswith("HTTP/1.1 200 OK")
    assert warc.read_archive(warc.write_archive(df.limit(0))).count() == 0


def test_a_changed_payload_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    archive = warc.write_archive(df)
    import zstandard

    forged = spark.createDataFrame([(r.digest, zstandard.compress(b"other")) for r in archive.payloads.collect()], archive.payloads.schema)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(warc.Archive(archive.headers, forged)).collect()
