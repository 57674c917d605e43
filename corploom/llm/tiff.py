"""TIFF media columns: image directories walked, strips and tiles decoded, one row per page.

The decoder reads classic and big TIFF of either byte order, walks the chain of
directories, undoes PackBits, LZW or deflate on strips or tiles, and the
horizontal and floating-point predictors.  The writer makes classic TIFF with
the same choices, and stores any bytes losslessly as 8-bit grey samples.

Cases: a null text is stored as an empty one, a page of zero bytes; a payload
over one page becomes several; a very long text is held whole, with its media,
several times over; repeated rows give equal media; a page that cannot be
decoded is a row without pixels and with the reason in `error`, beside those of
the other pages; null media, or a damaged chain of directories, add a row with
page -1 and the reason; an empty table gives an empty result; other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corploom.llm import blocks
from corploom.llm.shared import bound_batches

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class TiffError(ValueError):
    """Media that is not a TIFF this reader can decode."""


# codecs


def packbits_encode(raw: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(raw)
    data = np.frombuffer(raw, np.uint8)
    changes = np.flatnonzero(data[1:] != data[:-1]) + 1 if n > 1 else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], changes, [n]]) if n else np.zeros(1, np.int64)
    lengths = np.diff(bounds)
    for start, size in zip(bounds[:-1][lengths >= 3].tolist(), lengths[lengths >= 3].tolist()):
        while at < start:
            step = min(128, start - at)
            out.append(step - 1)
            out += raw[at : at + step]
            at += step
        while size:
            step = min(128, size)
            if step == 1:
                out += bytes((0, raw[at]))
            else:
                out += bytes((257 - step, raw[at]))
            at += step
            size -= step
    while at < n:
        step = min(128, n - at)
        out.append(step - 1)
        out += raw[at : at + step]
        at += step
    return bytes(out)


def packbits_decode(raw: bytes, most: int | None = None) -> bytes:
    """The bytes; decoding stops once there are ``most``."""
    out, at, n = bytearray(), 0, len(raw)
    while at < n and (most is None or len(out) < most):
        head = raw[at]
        if head < 128:
            out += raw[at + 1 : at + 2 + head]
            at += 2 + head
        elif head == 128:
            at += 1
        else:
            out += raw[at + 1 : at + 2] * (257 - head)
            at += 2
    return bytes(out)


def _lzw_widths(count: int) -> np.ndarray:
    """Bits of the codes after a clear code: most significant bit first, and widths grow one code early."""
    size = 258 + np.maximum(np.arange(count) - 1, 0)
    return 9 + (size >= 511).astype(np.int64) + (size >= 1023) + (size >= 2047)


_WIDTHS = _lzw_widths(1 << 14)
_BITS_BEFORE = np.concatenate([[0], np.cumsum(_WIDTHS)])
_SEGMENT = 4096  # codes taken from the bits at a time


def lzw_encode(raw: bytes) -> bytes:
    codes, table, new = [256], {}, 258
    known, add = table.get, codes.append
    rest = iter(raw)
    word = next(rest, None)
    if word is not None:
        for byte in rest:
            longer = known(word << 8 | byte)
            if longer is not None:
                word = longer
                continue
            add(word)
            table[word << 8 | byte] = new
            new += 1
            word = byte
            if new == 4095:
                add(256)
                table.clear()
                new = 258
        add(word)
    add(257)
    values = np.array(codes)
    clears = np.flatnonzero(values == 256)
    place = np.arange(len(values))
    place[1:] -= clears[np.searchsorted(clears, place[1:]) - 1] + 1
    widths = _WIDTHS[place]
    shift = widths[:, None] - 1 - np.arange(12)
    bits = (values[:, None] >> np.maximum(shift, 0) & 1).astype(np.uint8)
    return np.packbits(bits[shift >= 0]).tobytes()


def lzw_decode(raw: bytes, most: int | None = None) -> bytes:
    """The bytes; decoding stops once there are ``most``."""
    data = np.frombuffer(raw + bytes(4), np.uint8).astype(np.int64)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]  # 32 bits from each byte on
    single = [bytes((b,)) for b in range(256)] + [b"", b""]
    out: list[bytes] = []
    size, at, total = 0, 0, 8 * len(raw)
    table, last, begin = list(single), b"", 0
    while most is None or size < most:
        # Codes from bit `at`, as many as there are: the width of each follows from its place after the last clear code.
        here = np.minimum(begin + np.arange(_SEGMENT), len(_WIDTHS) - 1)
        widths = _WIDTHS[here]
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, side="right"))
        if not n:
            break
        first = ends[:n] - widths[:n]
        codes = window[first >> 3] >> (32 - (first & 7) - widths[:n]) & ((1 << widths[:n]) - 1)
        control = np.flatnonzero(codes >> 1 == 128)  # 256 and 257
        stop = int(control[0]) if len(control) else n
        for code in codes[:stop].tolist():
            if code < len(table):
                word = table[code]
            elif last and code == len(table):
                word = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            out.append(word)
            size += len(word)
            if last:
                table.append(last + word[:1])
            last = word
            if most is not None and size >= most:
                break
        if stop < n:
            if codes[stop] == 257:
                break
            table, last, begin, at = list(single), b"", 0, int(ends[stop])
        else:
            begin, at = begin + n, int(ends[n - 1])
    return b"".join(out)


def _decompress(method: int, raw: bytes, most: int) -> bytes:
    """At least ``most`` bytes, where there are as many; what a stream holds beyond is not expanded."""
    if method == NONE:
        return raw
    if method == LZW:
        return lzw_decode(raw, most)
    if method in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(raw, max(1, most))
    if method == PACKBITS:
        return packbits_decode(raw, most)
    raise TiffError(f"compression {method} is not supported")


def _compress(method: int, raw: bytes) -> bytes:
    if method == LZW:
        return lzw_encode(raw)
    if method == DEFLATE:
        return zlib.compress(raw, 1)
    if method == PACKBITS:
        return packbits_encode(raw)
    return raw


# reading


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    photometric: int
    pixels: bytes  # rows of samples, in the machine-independent little-endian order


def _directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", raw, 2)[0]
    if magic == 42:
        (at,) = struct.unpack_from(order + "I", raw, 4)
        count_code, offset_code, entry = "H", "I", 12
    elif magic == 43:
        (at,) = struct.unpack_from(order + "Q", raw, 8)
        count_code, offset_code, entry = "Q", "Q", 20
    else:
        raise TiffError("no TIFF header")
    wide = struct.calcsize(offset_code)
    seen = set()
    while at:
        if at in seen:
            raise TiffError("directories form a cycle")
        seen.add(at)
        (n,) = struct.unpack_from(order + count_code, raw, at)
        if n * entry > len(raw):
            raise TiffError("a directory is longer than the file")
        at += struct.calcsize(count_code)
        tags: dict[int, tuple] = {}
        for k in range(n):
            here = at + k * entry
            tag, kind = struct.unpack_from(order + "HH", raw, here)
            (count,) = struct.unpack_from(order + offset_code, raw, here + 4)
            code = _TYPES.get(kind)
            if code is None:
                continue
            where = here + 4 + wide
            if count > len(raw):
                raise TiffError("a tag has more values than the file has bytes")
            if count * struct.calcsize(code) > wide:
                (where,) = struct.unpack_from(order + offset_code, raw, where)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", raw, where)
        yield order, tags
        (at,) = struct.unpack_from(order + offset_code, raw, at + n * entry)


def _unpredict(piece: np.ndarray, predictor: int, order: str, bits: int) -> np.ndarray:
    """Samples of a strip or tile (rows, columns, samples of `bits`), from its bytes (rows, bytes)."""
    rows = piece.shape[0]
    size = bits // 8
    samples = piece.shape[2]
    if predictor == 3:
        flat = piece.reshape(rows, -1)
        summed = np.cumsum(flat.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, -1)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)[:, :, ::-1]).reshape(rows, -1).view(f"<u{size}").reshape(rows, -1, samples)
    values = np.ascontiguousarray(piece.reshape(rows, -1)).view(f"{order}u{size}").astype(f"<u{size}").reshape(rows, -1, samples)
    if predictor == 2:
        values = np.cumsum(values, axis=1, dtype=values.dtype)
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} is not supported")
    return values


_DAMAGE = (struct.error, zlib.error, KeyError, IndexError, ValueError, TypeError, OverflowError, ZeroDivisionError, MemoryError)
#: No codec here makes more bytes of one: what claims to is damaged, and no memory is taken for it.
_MOST_GROWTH = 1500
_MOST_PAGE_BYTES = (1 << 31) - 1  # of one value in an Arrow column


def walk_pages(raw: bytes) -> tuple[list[Page | TiffError], TiffError | None]:
    """Each page or why it cannot be decoded, and what is wrong with the chain of directories, if anything."""
    pages: list[Page | TiffError] = []
    try:
        for order, tags in _directories(raw):
            try:
                pages.append(_page(raw, order, tags))
            except _DAMAGE as e:
                pages.append(e if isinstance(e, TiffError) else TiffError(f"damaged page: {type(e).__name__} {e}"))
    except _DAMAGE as e:
        return pages, e if isinstance(e, TiffError) else TiffError(f"damaged TIFF: {e}")
    return pages, None if pages else TiffError("no directory")


def read_pages(raw: bytes) -> Iterator[Page]:
    """The pages of a TIFF, decoded; the first that cannot be raises."""
    pages, wrong = walk_pages(raw)
    for page in pages:
        if isinstance(page, TiffError):
            raise page
        yield page
    if wrong:
        raise wrong


def _unpack_bits(rows: np.ndarray, depth: int, count: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, a byte each, from rows that begin at whole bytes."""
    bits = np.unpackbits(rows, axis=1)[:, : count * depth].reshape(len(rows), count, depth)
    return bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)


def _page(raw: bytes, order: str, tags: dict[int, tuple]) -> Page:
    width, height = tags[256][0], tags[257][0]
    samples = tags.get(277, (1,))[0]
    bits = set(tags.get(258, (1,)))
    if len(bits) != 1 or not bits <= {1, 2, 4, 8, 16, 32, 64}:
        raise TiffError(f"samples of {sorted(bits)} bits are not supported")
    (depth,) = bits
    method, predictor, planar = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0]
    if depth < 8 and predictor != 1:
        raise TiffError(f"predictor {predictor} on samples of {depth} bits is not supported")
    tiled = 322 in tags
    piece_width, piece_height = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, (height,))[0], height) or 1)
    if samples < 1 or (width and height and (piece_width < 1 or piece_height < 1)):
        raise TiffError("a page without samples, or tiles without size")
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = (-(-width // piece_width), -(-height // piece_height)) if width and height else (0, 0)
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    pieces = across * down * planes
    size = max(1, depth // 8)
    held = sum(min(n, len(raw)) for n in sizes[:pieces])
    if len(offsets) < pieces or len(sizes) < pieces or max(height * width * samples * depth // 8, piece_height * piece_width * each * depth // 8) > _MOST_GROWTH * max(held, 1):
        raise TiffError("a page claims more samples than its strips or tiles hold")
    if height * width * samples * size > _MOST_PAGE_BYTES:
        raise TiffError("a page has more bytes than a column value can hold")
    image = np.zeros((height, width, samples), f"<u{size}")
    row_bytes = -(-piece_width * each * depth // 8)
    for k in range(pieces):
        plane, place = divmod(k, across * down)
        y, x = place // across * piece_height, place % across * piece_width
        rows = piece_height if tiled else min(piece_height, height - y)
        data = _decompress(method, raw[offsets[k] : offsets[k] + sizes[k]], rows * row_bytes)
        if len(data) < rows * row_bytes:
            raise TiffError("a strip or tile is short")
        flat = np.frombuffer(data, np.uint8, rows * row_bytes).reshape(rows, row_bytes)
        if depth < 8:
            values = _unpack_bits(flat, depth, piece_width * each).reshape(rows, piece_width, each)
        else:
            values = _unpredict(flat.reshape(rows, piece_width * size, each), predictor, order, depth)
        target = image[y : y + rows, x : x + piece_width, plane : plane + each]
        target[...] = values[: target.shape[0], : target.shape[1]]
    return Page(width, height, samples, depth, method, tags.get(262, (1,))[0], image.tobytes())


# writing


@dataclass(frozen=True)
class Layout:
    compression: int = DEFLATE
    predictor: int = 1
    rows_per_strip: int = 256
    tile: tuple[int, int] | None = None  # width and height, multiples of 16
    order: str = "<"


def write_tiff(pages: list[np.ndarray], layout: Layout) -> bytes:
    """A classic TIFF of grey pages (rows, columns) of unsigned samples."""
    o = layout.order
    out = bytearray((b"II" if o == "<" else b"MM") + struct.pack(o + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        wide, high = layout.tile or (width, layout.rows_per_strip)
        offsets, sizes = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                piece = page[y : y + high, x : x + wide]
                if layout.tile:
                    piece = np.pad(piece, ((0, high - piece.shape[0]), (0, wide - piece.shape[1])))
                if layout.predictor == 2:
                    piece = np.diff(piece, axis=1, prepend=piece[:, :1] * 0)
                data = _compress(layout.compression, piece.astype(page.dtype.newbyteorder(o)).tobytes())
                offsets.append(len(out))
                sizes.append(len(data))
                out += data
        tags = {256: width, 257: height, 258: page.dtype.itemsize * 8, 259: layout.compression, 262: 1, 277: 1, 284: 1, 317: layout.predictor}
        lists = {324: offsets, 325: sizes} if layout.tile else {273: offsets, 279: sizes}
        tags |= {322: wide, 323: high} if layout.tile else {278: high}
        entries = []
        for tag, values in sorted([(t, [v]) for t, v in tags.items()] + list(lists.items())):
            if len(values) == 1:
                entries.append(struct.pack(o + "HHII", tag, 4, 1, values[0]))
            else:
                entries.append(struct.pack(o + "HHII", tag, 4, len(values), len(out)))
                out += struct.pack(f"{o}{len(values)}I", *values)
        out += b"\0" * (len(out) & 1)
        struct.pack_into(o + "I", out, link, len(out))
        out += struct.pack(o + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(o + "I", 0)
    return bytes(out)


@dataclass(frozen=True)
class PayloadParameters:
    """Pages of `width` samples and at most `page_rows` rows; the codec follows from the number of rows."""

    width: int = 64
    page_rows: int = 16384
    strip_rows: int = 256

    def layout(self, rows: int) -> Layout:
        kind = rows % 4
        if kind == 0:
            return Layout(PACKBITS, rows_per_strip=self.strip_rows)
        if kind == 1:
            return Layout(DEFLATE, predictor=2, rows_per_strip=self.strip_rows)
        if kind == 2:
            return Layout(DEFLATE, tile=(32, 64))
        return Layout(LZW, rows_per_strip=self.strip_rows)


def store_payload(raw: bytes, p: PayloadParameters) -> bytes:
    """Bytes, padded with zeros to a positive number of whole rows, as a TIFF."""
    rows = max(1, -(-len(raw) // p.width))
    samples = np.frombuffer(raw.ljust(rows * p.width, b"\0"), np.uint8).reshape(rows, p.width)
    return write_tiff([samples[y : y + p.page_rows] for y in range(0, rows, p.page_rows)], p.layout(rows))


def store_texts(docs: DataFrame, p: PayloadParameters | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, a TIFF of the text's UTF-8 bytes, of every row."""
    p = p or PayloadParameters()
    bound_batches(docs.sparkSession)

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = part.column(1).fill_null("").cast(pa.binary()).to_pylist()
                media = [store_payload(x, p) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_column].cast("long"), docs[text_column]).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


_PAGE_FIELDS = "page int, n_pages int, width int, height int, samples int, bits int, compression int, pixels binary, media_bytes long, media_sha256 string, error string"


def decode_pages(media: DataFrame, media_column: str = "media", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each TIFF, with the kept columns, in page order and with no other row between.

    A page that cannot be decoded has its `error` and no pixels; a damaged chain
    of directories adds a row of page -1 before those of the pages it gave.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keep).schema), _PAGE_FIELDS])
    names = [*keep, *(x.split()[0] for x in _PAGE_FIELDS.split(", "))]
    bound_batches(media.sparkSession)
    kinds = [pa.int32()] * 7 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, found = [], []
                for k, raw in enumerate(part.column(len(keep)).to_pylist()):
                    digest = None if raw is None else hashlib.sha256(raw).hexdigest()
                    size = None if raw is None else len(raw)
                    pages, wrong = walk_pages(raw or b"")
                    mine = [] if wrong is None else [(-1, len(pages), *[None] * 6, size, digest, str(wrong))]
                    for n, g in enumerate(pages):
                        own = (*[None] * 6, size, digest, str(g)) if isinstance(g, TiffError) else (g.width, g.height, g.samples, g.bits, g.compression, g.pixels, size, digest, None)
                        mine.append((n, len(pages), *own))
                    owner += [k] * len(mine)
                    found += mine
                kept = [part.column(k).take(pa.array(owner, pa.int32())) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names=names)

    return media.select(*keep, media_column).mapInArrow(rows, schema)


def page_features(pages: DataFrame) -> DataFrame:
    """Per stored payload, from its consecutive page rows: digests of the bytes read back, and their statistics.

    A payload with a page or chain that cannot be decoded has no digests, and the reason as its feature.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size, total, square, bends, wrong = hashlib.sha256(), 0, 0, 0, 0, None
        for batch in batches:
            out = []
            for doc, n_bytes, page, n_pages, pixels, media_bytes, media_sha, error in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if page == 0 or page == -1:
                    sha, size, total, square, bends, wrong = hashlib.sha256(), 0, 0, 0, 0, wrong if page == 0 else None
                wrong = wrong or error
                if pixels is not None:
                    sha.update(pixels)
                    values = np.frombuffer(pixels, np.uint8)
                    counts = np.bincount(values, minlength=256)
                    size += len(pixels)
                    total += int(counts @ np.arange(256))
                    square += int(counts @ np.arange(256) ** 2)
                    bends += int(np.count_nonzero(values[1:] != values[:-1]))
                if page == n_pages - 1:
                    if wrong is not None:
                        out.append((doc, n_bytes, None, None, None, media_bytes, media_sha, f"error={wrong}"))
                    else:
                        n = max(size, 1)
                        feature = f"pages={n_pages};mean={1000 * total // n};var={(1000 * square - 1000 * total * total // n) // n};edges={1000 * bends // n}"
                        out.append((doc, n_bytes, size, sha.hexdigest(), zlib.crc32(pixels[-64:]), media_bytes, media_sha, feature))
                    wrong = None
            columns = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return pages.select("doc_id", "n_bytes", "page", "n_pages", "pixels", "media_bytes", "media_sha256", "error").mapInArrow(rows, schema)
