"""Media columns in baseline JPEG, and a numpy decoder for their DC-only luminance thumbnails.

Storing: a payload of bytes becomes a greyscale baseline JPEG in which each flat 8x8 block holds one sample,
so its DC coefficient is that byte exactly (quantiser 8, no AC): the thumbnail of one pixel a block *is* the
payload. Every row of blocks is a restart interval; the true length stands in a comment segment. Payloads
beyond the largest frame continue in further frames of the same stream.

Reading: markers are parsed, stuffing removed, and scans Huffman-decoded. Restart intervals are independent,
so all intervals of a batch of images step together, one symbol each at a time, in numpy. AC symbols are
decoded and skipped; the DC values of the luminance component make the thumbnail. Any baseline image with
one interleaved scan is read (several components, subsampling, AC coefficients, with or without restarts).

Long payloads and scans go in groups of restart intervals, so the arrays of a step stay small; a foreign image without
restarts is one interval.

Defined results: null and empty texts store one row of 32s and length 0; a text of any length is stored
whole; equal texts give equal bytes; repeated rows and null doc_ids pass through; null media has null fields; media that
cannot be read have null fields and a reason. An empty table gives no rows. Columns named like those that ``read_media``
adds give way to them; all others pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgraph.llm.common import slices

UNIT, MOST_BLOCKS, FILL = 192, 8191, 32
#: Samples, or bytes of scans, that one step works on.
STEP = 2_000_000
#: Comments of our own, and what reading a malformed stream may raise.
OURS = re.compile(rb"n=(\d+);(\d+)")
BAD = (ValueError, IndexError, KeyError, ZeroDivisionError)
#: Code lengths of the standard's example table for luminance DC, whose symbols are 0 to 11.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
#: Our media have no AC coefficients: the end of a block is the only symbol, of one bit.
AC_COUNTS = [1] + [0] * 15


def _codes(counts: list[int], symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in canonical order."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may follow: symbol and code length (0: no such code)."""
    out = np.zeros(65536, np.int32)
    for symbol, code, length in _codes(list(table[:16]), table[16:]):
        out[code << 16 - length : code + 1 << 16 - length] = symbol << 8 | length
    return out


@lru_cache(1)
def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: its bits (code, extra bits, end of block) and their number."""
    code = {s: (c, n) for s, c, n in _codes(DC_COUNTS, bytes(range(12)))}
    bits, count = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = code[size]
        extra = d if d > 0 else d + (1 << size) - 1
        bits[d + 255], count[d + 255] = (c << size | (extra if size else 0)) << 1, n + size + 1
    return bits, count


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(width: int, rows: int, comment: bytes) -> bytes:
    return b"".join([
        b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(range(12))), _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + b"\x00"),
        _segment(0xDD, width.to_bytes(2, "big")), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def _entropy_coded(samples: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their offsets by row): rows of ``width`` samples as stuffed restart intervals, markers not yet set."""
    rows = len(samples) // width
    level = samples.reshape(rows, width).astype(np.int64) - 128
    bits_of, count_of = _dc_codes()
    diff = np.diff(level, axis=1, prepend=0) + 255
    bits, count = bits_of[diff], count_of[diff]
    total = count.sum(axis=1)
    pad = -total % 8
    bits = np.concatenate([bits, ((1 << pad) - 1)[:, None]], axis=1).ravel()
    count = np.concatenate([count, pad[:, None]], axis=1).ravel()
    end = np.cumsum(count)
    start = end - count
    v = bits.astype(np.uint64) << (64 - count - (start & 31)).astype(np.uint64)
    v[count == 0] = 0
    n = int(end[-1] >> 5) + 2
    at = start >> 5
    words = np.bincount(at, (v >> np.uint64(32)).astype(np.float64), n) + np.bincount(at + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    packed = words.astype(np.uint32).astype(">u4").view(np.uint8)[: int(end[-1] >> 3)]
    row_end = np.cumsum((total + pad) >> 3)
    # room after each byte: one for stuffing, two for a marker after each row
    extra = (packed == 255).astype(np.int64)
    extra[row_end - 1] += 2
    place = np.arange(len(packed)) + np.cumsum(extra) - extra
    out = np.zeros(len(packed) + int(extra.sum()), np.uint8)
    out[place] = packed
    return out, place[row_end - 1] + 1 + (packed[row_end - 1] == 255)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One media stream for each payload."""
    jobs = []
    for i, payload in enumerate(payloads):
        padded = payload.ljust(max(UNIT, -(-len(payload) // UNIT) * UNIT), bytes([FILL]))
        most = MOST_BLOCKS // UNIT * UNIT * MOST_BLOCKS
        for begin in range(0, len(padded), most):
            part = padded[begin : begin + most]
            width = UNIT * -(-len(part) // (UNIT * MOST_BLOCKS))
            jobs.append((i, width, part.ljust(-(-len(part) // width) * width, bytes([FILL])), b"n=%d;%d" % (max(0, min(len(payload) - begin, most)), len(part))))
    out: list[list[bytes]] = [[] for _ in payloads]
    coded: dict[int, bytes] = {}
    for width in {j[1] for j in jobs}:
        own = [k for k, j in enumerate(jobs) if j[1] == width]
        while own:
            # some jobs of few rows together, or one job in runs of rows
            total, n = 0, 0
            while n < len(own) and (not n or total + len(jobs[own[n]][2]) <= STEP):
                total += len(jobs[own[n]][2])
                n += 1
            here, own = own[:n], own[n:]
            data = np.frombuffer(b"".join([jobs[k][2] for k in here]), np.uint8)
            row_of = np.concatenate([np.arange(len(jobs[k][2]) // width) for k in here])
            ends = np.cumsum([len(jobs[k][2]) // width for k in here])
            most, scans, cuts = max(1, STEP // width), [], []
            for first in range(0, len(row_of), most):
                scan, marks = _entropy_coded(data[first * width : (first + most) * width], width)
                scan[marks], scan[marks + 1] = 0xFF, 0xD0 + row_of[first : first + most] % 8
                cuts.append(marks + 2 + sum(map(len, scans)))
                scans.append(scan)
            scan, cut = np.concatenate(scans), np.concatenate(cuts)
            scan[cut[ends - 1] - 1] = 0xD9
            for k, begin, end in zip(here, [0, *cut[ends - 1][:-1].tolist()], cut[ends - 1].tolist()):
                coded[k] = _header(width, len(jobs[k][2]) // width, jobs[k][3]) + scan[begin:end].tobytes()
    for k, job in enumerate(jobs):
        out[job[0]].append(coded[k])
    return [b"".join(x) for x in out]


@dataclass
class Frame:
    """What the markers of one image tell."""

    width: int = 0
    height: int = 0
    restart: int = 0
    comment: bytes = b""
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    chosen: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    begin: int = 0
    end: int = 0
    thumbnail: np.ndarray | None = None


def parse(data: bytes) -> list[Frame]:
    """The frames of a stream; ValueError for what is not baseline with one scan."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at, frame = at + 2, Frame()
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker was expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                frame.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    frame.tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xC0:
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body[:2], "big")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xDA:
                ids = [p[0] for p in frame.parts]
                frame.chosen = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                if len(frame.chosen) != len(frame.parts):
                    raise ValueError("more than one scan")
                break
        frame.begin = at
        end = data.find(b"\xff\xd9", at)
        if end < 0:
            raise ValueError("no end of image")
        frame.end, at = end, end + 2
        out.append(frame)
    if not out:
        raise ValueError("no image")
    return out


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes without stuffing and markers, where each interval begins)."""
    ff = (scan[:-1] == 0xFF).nonzero()[0]
    if not len(ff):
        return scan, np.zeros(1, np.int64)
    after = scan[ff + 1]
    drop = np.zeros(len(scan), bool)
    drop[ff[after == 0] + 1] = True
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop[marks] = drop[marks + 1] = True
    kept = np.cumsum(~drop)
    return scan[~drop], np.concatenate([[0], kept[marks]])


def _scanned(data: np.ndarray, starts: np.ndarray, mcus: np.ndarray, tables: np.ndarray, part_of: np.ndarray, luma: list[int], parts: int) -> np.ndarray:
    """DC levels of luminance blocks of restart intervals, which step together, one symbol each at a time."""
    if int(mcus.sum()) * len(part_of) > 4 * len(data):
        raise ValueError("the data end early")  # a block takes two bits at least
    flat = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.int32)
    window = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
    window = window.view(np.uint32).astype(np.int64)
    pos, left = starts * 8, mcus * len(part_of)
    base = np.concatenate([[0], np.cumsum(mcus * len(luma))])
    dc = np.zeros(base[-1], np.int32)
    put = base[:-1].copy()
    block, k = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    last = np.zeros((len(pos), parts), np.int64)
    several, only_luma = len(part_of) > 1, parts == 1
    live = np.arange(len(pos))
    limit = len(data) * 8
    while len(live):
        peek = window[np.minimum(pos >> 3, len(window) - 1)] << (pos & 7) & 0xFFFFFFFF
        is_dc = k == 0
        table = (2 * block + ~is_dc if several else (~is_dc).astype(np.int64)) << 16
        found = tables[table + (peek >> 16)]
        length, symbol = found & 255, found >> 8
        if not length.all():
            raise ValueError("no such code")
        extra = symbol & 15
        if is_dc.any():
            at = slice(None) if is_dc.all() else is_dc.nonzero()[0]
            n = extra[at]
            value = (peek[at] << length[at] & 0xFFFFFFFF) >> (32 - n)
            value = np.where(n == 0, 0, np.where(value >> np.maximum(n - 1, 0) & 1, value, value - (1 << n) + 1))
            if only_luma:
                last[at, 0] += value
                dc[put[at]] = last[at, 0]
                put[at] += 1
            else:
                who = np.arange(len(live))[at]
                part = part_of[block[at]]
                last[who, part] += value
                y = who[part == 0]
                dc[put[y]] = last[y, 0]
                put[y] += 1
            k = np.where(is_dc, 1, k)
        if not is_dc.all():
            run = symbol >> 4
            step = np.where((extra == 0) & (run < 15), 64, run + 1)
            k = np.where(is_dc, k, k + step)
        pos = pos + length + extra
        over = k >= 64
        if over.any():
            k = np.where(over, 0, k)
            left = left - over
            if several:
                block = np.where(over, (block + 1) % len(part_of), block)
            done = left == 0
            if done.any():
                if (pos[done] > limit).any():
                    raise ValueError("the data end early")
                stay = ~done
                pos, k, left, block, last, put, live = (x[stay] for x in (pos, k, left, block, last, put, live))
    return dc


def _decode(jobs: list[tuple[bytes, Frame]]) -> None:
    """Thumbnails of frames whose components and code tables are alike."""
    first = jobs[0][1]
    layout = [(c, dc, ac) for place, dc, ac in first.chosen for c in [place] * (1 if len(first.parts) == 1 else first.parts[place][1] * first.parts[place][2])]
    luma = [i for i, (c, _, _) in enumerate(layout) if c == 0]
    tables = np.concatenate([_lookup(first.tables[t]) for _, dc, ac in layout for t in (dc, 0x10 | ac)])
    part_of = np.array([c for c, _, _ in layout])
    across, down = (1, 1) if len(first.parts) == 1 else (max(p[1] for p in first.parts), max(p[2] for p in first.parts))
    data, starts, mcus, spans, total = [], [], [], [], 0
    for stream, frame in jobs:
        wide, high = -(-frame.width // (8 * across)), -(-frame.height // (8 * down))
        clean, begin = _intervals(np.frombuffer(stream, np.uint8, frame.end - frame.begin, frame.begin))
        step = frame.restart or wide * high
        counts = np.minimum(step, wide * high - step * np.arange(len(begin)))
        if counts[-1] <= 0 or counts.sum() != wide * high:
            raise ValueError("restart intervals and size disagree")
        data.append(clean)
        starts.append(begin + total)
        mcus.append(counts)
        spans.append((wide, high, len(begin)))
        total += len(clean)
    whole, begins, counts = np.concatenate(data), np.concatenate(starts).astype(np.int64), np.concatenate(mcus).astype(np.int64)
    only_luma = len(first.parts) == 1
    found, at = [], 0
    while at < len(begins):
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + STEP)))
        stop = begins[end] if end < len(begins) else total
        found.append(_scanned(whole[begins[at] : stop], begins[at:end] - begins[at], counts[at:end], tables, part_of, luma, len(first.parts)))
        at = end
    dc = np.concatenate(found)
    h, v = (1, 1) if only_luma else (first.parts[0][1], first.parts[0][2])
    at = 0
    for (_, frame), (wide, high, _) in zip(jobs, spans):
        n = wide * high * h * v
        grid = dc[at : at + n].reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        at += n
        level = np.rint(grid * frame.quant[frame.parts[0][3]] / 8 + 128)
        frame.thumbnail = np.clip(level, 0, 255).astype(np.uint8)[: -(-frame.height * v // (8 * down)), : -(-frame.width * h // (8 * across))]


def decode(streams: list[bytes]) -> list[list[Frame]]:
    """The frames of each stream, with their thumbnails."""
    frames = [parse(s) for s in streams]
    alike: dict[tuple, list[tuple[bytes, Frame]]] = {}
    for stream, own in zip(streams, frames):
        for f in own:
            key = (tuple(sorted(f.tables.items())), tuple(p[1:3] for p in f.parts), tuple(f.chosen))
            alike.setdefault(key, []).append((stream, f))
    for jobs in alike.values():
        _decode(jobs)
    return frames


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 8 x 8 areas are brighter than their mean."""
    rows, cols = (np.arange(8) * n // 8 for n in pixels.shape)
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), np.minimum(rows, pixels.shape[0] - 1), axis=0), np.minimum(cols, pixels.shape[1] - 1), axis=1)
    ends = (np.maximum(np.diff(np.append(x, n)), 1) for x, n in zip((rows, cols), pixels.shape))
    area = np.outer(*ends)
    return np.packbits(sums * area.sum() > area * sums.sum()).tobytes().hex()


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the UTF-8 bytes of each whole text as a media stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                media = encode([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def _told(frames: list[Frame] | str | None) -> tuple:
    if not isinstance(frames, list):
        return (None,) * 5 + (frames,)
    ours = [OURS.fullmatch(f.comment) for f in frames]
    pixels = b"".join([f.thumbnail.ravel()[: int(m[2])].tobytes() if m else f.thumbnail.tobytes() for f, m in zip(frames, ours)])
    n = sum(int(m[1]) for m in ours) if all(ours) else None
    return (frames[0].width, frames[0].height, n, pixels, thumbnail_hash(frames[0].thumbnail), None)


def _read(streams: list[bytes]) -> list[list[Frame] | str]:
    """The frames of each stream, or why it cannot be read; one bad stream costs no other."""
    try:
        return decode(streams)
    except BAD as e:
        if len(streams) == 1:
            return [str(e) or type(e).__name__]
        half = len(streams) // 2
        return _read(streams[:half]) + _read(streams[half:])


def read_media(stored: DataFrame) -> DataFrame:
    """``stored`` (any columns, with ``media``) and width, height, n_bytes, thumbnail (pixels by row), thumbnail_hash, reason.

    width and height are those of the first frame in samples; n_bytes is the length told in the comments
    (of foreign images null); the thumbnail is that of all frames in turn; the hash is of the first frame; reason is
    why media could not be read, else null.
    """
    added = [("width", T.IntegerType()), ("height", T.IntegerType()), ("n_bytes", T.LongType()), ("thumbnail", T.BinaryType()), ("thumbnail_hash", T.StringType()), ("reason", T.StringType())]
    stored = stored.drop(*(n for n, _ in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", 2_500_000):
                media = batch.column(batch.schema.get_field_index("media")).to_pylist()
                read = iter(_read([m for m in media if m is not None]))
                rows = [_told(None if m is None else next(read)) for m in media]
                new = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(n for n, _ in added)])

    return stored.mapInArrow(run, T.StructType([*stored.schema.fields, *(T.StructField(n, t) for n, t in added)]))
