"""ISO media containers: writing a track of fixed-size samples, and reading the container's tables without the payload.

``probe`` walks nested boxes (32- and 64-bit sizes, boxes that run to the end), decodes the sample tables (sizes, chunks,
times, sync samples) and gives codec, duration and the byte ranges of all keyframes. ``stored`` writes texts as containers in a
table's column, ``described`` reads that column back; ``describe`` does both.

Null text is the empty text, whose payload is 64 zero bytes. Equal texts give equal rows, repeated rows too; a null doc_id is
carried; other columns are ignored; very long texts are stored whole, with a 64-bit box where 32 bits don't hold the size. An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

#: Bytes of a sample (one 8-bit value a tick of the clock), samples of a chunk, samples from one keyframe to the next, ticks a second.
SAMPLE, CHUNK, KEY_EVERY, TIMESCALE = 64, 256, 32, 8000
CODEC = b"raw "
#: Boxes that hold boxes.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"])


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return struct.pack(">I4s", size, kind) + b"".join(parts) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(kind: bytes, entry: str, rows: list[tuple]) -> bytes:
    return full(kind, struct.pack(">I", len(rows)), b"".join(struct.pack(entry, *r) for r in rows))


def padded(data: bytes, unit: int = SAMPLE) -> bytes:
    return data + b"\0" * (-len(data) % unit if data else unit)


def write(payload: bytes) -> bytes:
    """A container with one track of 8-bit samples that holds the payload, whose length is a multiple of SAMPLE."""
    n = len(payload) // SAMPLE
    chunks = [min(CHUNK, n - k) for k in range(0, n, CHUNK)]
    runs = [(1, CHUNK, 1)] if len(chunks) > 1 or chunks[0] == CHUNK else []
    if chunks[-1] != CHUNK:
        runs.append((len(chunks), chunks[-1], 1))
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))

    def movie(first: int) -> bytes:
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            table(b"stts", ">II", [(n, SAMPLE)]),
            table(b"stss", ">I", [(k + 1,) for k in range(0, n, KEY_EVERY)]),
            table(b"stsc", ">III", runs),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            table(b"co64", ">Q", [(first + k * CHUNK * SAMPLE,) for k in range(len(chunks))]),
        )
        track = box(
            b"trak",
            full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * SAMPLE), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=3),
            box(
                b"mdia",
                full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * SAMPLE, 0x55C4, 0)),
                full(b"hdlr", bytes(4), b"soun", bytes(13)),
                box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
            ),
        )
        head = full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n * SAMPLE), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, track)

    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    first = len(brand) + len(movie(0)) + head
    return brand + movie(first) + box(b"mdat", payload)


def walk(data, start: int = 0, end: int | None = None, above: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, first byte of the body, end) of every box, outer before inner. A box cut short ends with the file."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else at + size
        if stop < body:
            raise ValueError(f"box {kind!r} at {at} is smaller than its head")
        yield (*above, kind), body, min(stop, end)
        if kind in CONTAINERS:
            yield from walk(data, body, min(stop, end), (*above, kind))
        at = stop


def numbers(data, at: int, stop: int, count: int, kind: str = "I") -> list:
    """So many numbers (or tuples of them) from a byte on; of a table cut short, those that are there."""
    one = struct.calcsize(">" + kind)
    count = max(0, min(count, (stop - at) // one))
    found = struct.iter_unpack(">" + kind, data[at : at + count * one])
    return [x[0] for x in found] if len(kind) == 1 else list(found)


def number(data, at: int, stop: int, kind: str = "I") -> int:
    """One number, 0 where the box ends before."""
    return (numbers(data, at, stop, 1, kind) or [0])[0]


def probe(data) -> list[dict]:
    """Of each track: codec, timescale, duration (the samples' times added up, or the head's where no table gives times), times
    as (sample, start, time of each) of runs of samples, samples as (offset, size), and keyframes as sample numbers from 0.

    Samples of fragments (moof boxes) follow those of the movie's own tables, each with the time that its fragment gives. A box
    or table cut short counts as far as it goes; tables of samples without chunks give no samples; what is no ISO file has no
    tracks. Composition times and edit lists move no bytes and are not read.
    """
    tracks: list[dict] = []
    defaults: dict[int, tuple[int, int, int]] = {}  # track: time, size, flags of samples
    moof, base, each, owner = 0, 0, (0, 0, 0), None
    for path, at, stop in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"id": 0, "codec": "", "timescale": 0, "duration": 0, "sizes": [], "chunks": [], "runs": [], "times": [], "keys": None, "more": []})
        elif kind == b"moof":
            moof = at - (8 if bytes(data[at - 4 : at]) == kind else 16)
        elif kind == b"trex":
            t, _, time, size, flags = (numbers(data, at + 4, stop, 5) + [0] * 5)[:5]
            defaults[t] = (time, size, flags)
        elif kind == b"tfhd":
            flags, t = number(data, at, stop) & 0xFFFFFF, number(data, at + 4, stop)
            owner, each, base, k = next((x for x in tracks if x["id"] == t), None), defaults.get(t, (0, 0, 0)), moof, at + 8
            if flags & 1:
                base, k = number(data, k, stop, "Q"), k + 8
            k += 4 * bool(flags & 2)
            given = list(each)
            for j, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    given[j], k = number(data, k, stop), k + 4
            each = tuple(given)
            if owner is not None:
                owner["next"] = base
        elif kind == b"trun" and owner is not None:
            flags, n, k = number(data, at, stop) & 0xFFFFFF, number(data, at + 4, stop), at + 8
            if flags & 1:
                offset, k = base + number(data, k, stop, "i"), k + 4
            else:
                offset = owner.get("next", base)
            first = None
            if flags & 4:
                first, k = number(data, k, stop), k + 4
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            rows = numbers(data, k, stop, n * len(fields)) if fields else []
            for i in range(len(rows) // len(fields) if fields else min(n, len(data))):
                own = dict(zip(fields, rows[i * len(fields) : (i + 1) * len(fields)]))
                time, size = own.get(0x100, each[0]), own.get(0x200, each[1])
                mark = first if first is not None and i == 0 else own.get(0x400, each[2])
                owner["more"].append((offset, size, time, not mark & 0x10000))
                offset += size
            owner["next"] = offset
        elif not tracks or b"trak" not in path:
            continue
        else:
            read_table(tracks[-1], kind, data, at, stop)
    for t in tracks:
        t["duration"] = t.pop("ticks", t["duration"])
        t["samples"] = list(placed(t["sizes"], t["chunks"], t["runs"]))
        keys = range(len(t["samples"])) if t["keys"] is None else [k for k in t["keys"] if 0 <= k < len(t["samples"])]  # no table: every sample is one
        if more := t.pop("more"):
            keys, start = [*keys, *(len(t["samples"]) + i for i, x in enumerate(more) if x[3])], t["duration"]
            for offset, size, time, _ in more:
                t["times"].append((len(t["samples"]), start, time))
                t["samples"].append((offset, size))
                start += time
            t["duration"] = start
        t["keys"] = keys
        t.pop("next", None)
    return tracks


def read_table(t: dict, kind: bytes, data, at: int, stop: int) -> None:
    """A box below a track."""
    if kind == b"tkhd":
        t["id"] = number(data, at + (20 if stop > at and data[at] == 1 else 12), stop)
    elif kind == b"mdhd":
        long = stop > at and data[at] == 1
        t["timescale"], t["duration"] = number(data, at + (20 if long else 12), stop), number(data, at + (24 if long else 16), stop, "Q" if long else "I")
    elif kind == b"stsd" and stop >= at + 16:
        t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
    elif kind == b"stsz":
        same, n = number(data, at + 4, stop), number(data, at + 8, stop)
        t["sizes"] = [same] * min(n, len(data)) if same else numbers(data, at + 12, stop, n)
    elif kind == b"stz2":
        bits, n = number(data, at + 7, stop, "B"), number(data, at + 8, stop)
        if bits == 4:
            t["sizes"] = [x for b in numbers(data, at + 12, stop, (n + 1) // 2, "B") for x in (b >> 4, b & 15)][:n]
        elif bits in (8, 16):
            t["sizes"] = numbers(data, at + 12, stop, n, "B" if bits == 8 else "H")
    elif kind in (b"stco", b"co64"):
        t["chunks"] = numbers(data, at + 8, stop, number(data, at + 4, stop), "Q" if kind == b"co64" else "I")
    elif kind == b"stss":
        t["keys"] = [k - 1 for k in numbers(data, at + 8, stop, number(data, at + 4, stop))]
    elif kind == b"stts":
        first = start = 0
        for count, time in numbers(data, at + 8, stop, number(data, at + 4, stop), "II"):
            t["times"].append((first, start, time))
            first, start = first + count, start + count * time
        if first:
            t["ticks"] = start
    elif kind == b"stsc":
        t["runs"] = [x[:2] for x in numbers(data, at + 8, stop, number(data, at + 4, stop), "III")]


def placed(sizes: list[int], chunks: list[int], runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(offset, size) of each sample."""
    k = run = 0
    for nth, offset in enumerate(chunks if runs else (), 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= nth:
            run += 1
        for size in sizes[k : k + runs[run][1]]:
            yield offset, size
            offset += size
            k += 1


def time_of(track: dict, sample: int) -> int:
    """When a sample starts, in ticks."""
    first, start, each = track["times"][bisect.bisect_right(track["times"], sample, key=lambda r: r[0]) - 1]
    return start + (sample - first) * each


def keyframes(track: dict) -> list[tuple[int, int, float]]:
    """(offset, size, start in seconds) of every keyframe; without a table of times the start is NaN."""
    scale = track["timescale"] or 1
    return [(*track["samples"][k], time_of(track, k) / scale if track["times"] else math.nan) for k in track["keys"]]


def payload_of(data, track: dict) -> bytes:
    """The samples' bytes in order; neighbouring samples are read as one range."""
    ranges: list[list[int]] = []
    for offset, size in track["samples"]:
        if ranges and ranges[-1][1] == offset:
            ranges[-1][1] += size
        else:
            ranges.append([offset, offset + size])
    return b"".join(data[a:b] for a, b in ranges)


def feature(track: dict) -> str:
    """Codec, duration in seconds, number of keyframes, first and last keyframe's byte range."""
    keys = [track["samples"][k] for k in (track["keys"][0], track["keys"][-1])] if len(track["keys"]) else []
    ends = " ".join(f"{o}+{s}" for o, s in keys)
    return f"codec={track['codec'].strip()} seconds={track['duration'] / (track['timescale'] or 1):.3f} samples={len(track['samples'])} keyframes={len(track['keys'])} ranges={ends}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the container) of every row, written to the shared folder."""

    def rows(batches):
        for b in slices(batches, 200):
            data = [(t or "").encode("utf-8") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, data), pa.int64()), pa.array([write(padded(d)) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_bytes long, media binary"), "media")


def described(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, keyframes of stored() rows.

    keyframes has (offset, size, seconds) of every keyframe, in order. Of several tracks the payload is that of one after the other,
    and so are feature (parted by " | ") and keyframes; what has no track has an empty payload and feature.
    """

    def rows(batches):
        for b in slices(batches, 200):
            out = []
            for doc, n_bytes, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = memoryview(media.as_buffer())
                tracks = probe(data)
                back = b"".join(payload_of(data, t) for t in tracks)
                frames = [dict(zip(("offset", "size", "seconds"), f)) for t in tracks for f in keyframes(t)]
                out.append((doc, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), " | ".join(map(feature, tracks)), frames))
            shape = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("seconds", pa.float64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "keyframes"])

    return media.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes array<struct<offset: bigint, size: bigint, seconds: double>>")


def describe(docs: DataFrame) -> DataFrame:
    """described() of docs as stored()."""
    return described(stored(docs))
