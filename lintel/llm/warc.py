"""WARC archives: writing crawls as monolithic gzip files, and the normaliser that makes every record a member of its own.

A monolithic archive is one gzip stream over many records, so no record can be read without inflating all before it.
``normalise`` inflates such a stream once, rewrites each record as its own gzip member (as a revisit where told so) and writes
a sidecar index of offsets; ``read_back`` then reads records by offset.

Null html is an empty payload. Rows with a null page_id are kept; they are responses unless a row with an id has the payload.
Of repeated rows (same id and payload), and of rows without id where no row with an id has the payload, the first by file name
is the response; file names are new in each run, but such rows are equal, so the result isn't. Null urls give an empty target. Other columns are
ignored; an empty table gives an empty result. Files are written under unique names and count only once listed in a written
table, so tasks can be run again.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, new_folder, open_store, remove, slices, staged

#: Payload bytes after which a new archive is begun; payloads under LEAST_REVISIT bytes are never revisits.
ARCHIVE_BYTES, LEAST_REVISIT, READ = 64 << 20, 100, 1 << 18
GZIP = 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, ident: str, target: str, block: bytes, **more: str) -> bytes:
    heads = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:lintel:{ident}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": target, "Content-Type": "application/http; msgtype=response", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in heads.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def target_uri(url: str | None) -> str:
    """The url on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def http(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def parse(heads: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in heads.decode().split("\r\n")[1:] if line)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an inflated stream, holding one record at a time."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        got = next(chunks, None)
        if got is not None:
            held.extend(got)
        return got is not None

    while True:
        searched = 0
        while (cut := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(held)
            if not more():
                if held.strip():
                    raise ValueError("the stream ends inside a record's headers")
                return
        heads = parse(bytes(held[:cut]))
        stop = cut + 4 + int(heads["Content-Length"])
        while len(held) < stop + 4:
            if not more():
                raise ValueError("the stream ends inside a record's block")
        yield heads, bytes(held[cut + 4 : stop])
        del held[: stop + 4]


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, in chunks."""
    engine = zlib.decompressobj(GZIP)
    while data := stream.read(READ):
        while data:
            out = engine.decompress(data, READ)
            if out:
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                engine = zlib.decompressobj(GZIP)
    if out := engine.flush():
        yield out


def member(data: bytes) -> bytes:
    engine = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return engine.compress(data) + engine.flush()


def normalise(stream, out, index, rewrite: Callable[[int, dict[str, str], bytes], bytes] | None = None) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Inflates ``stream`` once, writes each record to ``out`` as a member and a line to ``index``; yields (offset, length, headers).

    ``rewrite(number, headers, block)`` may give another record in its place.
    """
    at = 0
    for k, (heads, block) in enumerate(records(inflated(stream))):
        raw = rewrite(k, heads, block) if rewrite else "".join(["WARC/1.1\r\n", *(f"{a}: {b}\r\n" for a, b in heads.items()), "\r\n"]).encode() + block + b"\r\n\r\n"
        packed = member(raw)
        out.write(packed)
        index.write(f"{heads['WARC-Record-ID']} {at} {len(packed)}\n".encode())
        yield at, len(packed), heads
        at += len(packed)


def named(page: int | None, path: str, seq: int) -> str:
    """What names a record: its page, the archive that it was first written to, and its place there."""
    return f"{page}:{path.rsplit('/', 1)[-1].removesuffix('.warc.gz')}:{seq}"


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as monolithic archives; path, seq, page_id, payload_bytes, payload_digest of every record."""

    def write(batches):
        store, base = open_store(folder)
        store.create_dir(base)
        path, sink, engine, size, seq = "", None, None, 0, 0
        for b in slices(batches, 100):
            rows = []
            for page, url, html in zip(*(b.column(k).to_pylist() for k in range(3))):
                if sink is None or size >= ARCHIVE_BYTES:
                    if sink is not None:
                        sink.write(engine.flush())
                        sink.close()
                    path, size, seq = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink, engine = store.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP)
                payload = (html or "").encode("utf-8")
                digest = hashlib.sha256(payload).hexdigest()
                sink.write(engine.compress(record("response", named(page, path, seq), target_uri(url), http(payload), WARC_Payload_Digest=f"sha256:{digest}")))
                rows.append((path, seq, page, len(payload), digest))
                size += len(payload)
                seq += 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "seq", "page_id", "payload_bytes", "payload_digest"])
        if sink is not None:
            sink.write(engine.flush())
            sink.close()

    return staged(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, "path string, seq long, page_id long, payload_bytes long, payload_digest string"), "warc-list")


def revisits(listed: DataFrame) -> DataFrame:
    """listed with refers_to, first_path, first_seq (the record that one revisits) and is_revisit. The first record of each digest is found by a partial aggregate; digests that much
    of all records have are joined by broadcast."""
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "path", "seq")
    large = listed.where(F.col("payload_bytes") >= LEAST_REVISIT)
    firsts = large.groupBy("payload_digest").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = staged(firsts.select("payload_digest", F.col("f.page_id").alias("first_id"), F.col("f.path").alias("first_path"), F.col("f.seq").alias("first_seq"), "n"), "firsts")
    both = joined(large, firsts, "payload_digest", "n", "left")
    again = F.col("n").isNotNull() & ~((F.col("path") == F.col("first_path")) & (F.col("seq") == F.col("first_seq")))
    small = listed.where(F.col("payload_bytes") < LEAST_REVISIT)
    none = F.lit(None).cast("long")
    return both.select(*listed.columns, F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_path")).alias("first_path"), F.when(again, F.col("first_seq")).alias("first_seq"), again.alias("is_revisit")).unionByName(small.select(*listed.columns, none.alias("refers_to"), none.cast("string").alias("first_path"), none.alias("first_seq"), F.lit(False).alias("is_revisit")))


def normalise_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Normalises every archive in ``decided``; path, offset, length of every member. A task holds one archive's list."""

    def run(part: pa.Table) -> pa.Table:
        store, base = open_store(folder)
        store.create_dir(base)
        part = part.sort_by("seq")
        ids, refers, paths, seqs, again = (part[c].to_pylist() for c in ("page_id", "refers_to", "first_path", "first_seq", "is_revisit"))
        raw = part["path"][0].as_py()
        path = f"{base}/{uuid.uuid4().hex}.warc.gz"

        def rewrite(k, heads, block):
            head, _, payload = block.partition(b"\r\n\r\n")
            more = {"WARC_Payload_Digest": heads["WARC-Payload-Digest"], "WARC_Payload_Length": str(len(payload))}
            if again[k]:
                return record("revisit", named(ids[k], raw, k), heads["WARC-Target-URI"], head + b"\r\n\r\n", WARC_Profile=PROFILE, WARC_Refers_To=f"<urn:lintel:{named(refers[k], paths[k], seqs[k])}>", **more)
            return record("response", named(ids[k], raw, k), heads["WARC-Target-URI"], block, **more)

        with store.open_input_stream(raw, compression=None) as src, store.open_output_stream(path, compression=None) as out, store.open_output_stream(path.removesuffix(".warc.gz") + ".idx", compression=None) as index:
            rows = [(path, at, n) for at, n, _ in normalise(src, out, index, rewrite)]
        return pa.table({"path": [r[0] for r in rows], "offset": [r[1] for r in rows], "length": [r[2] for r in rows]}, pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return staged(decided.groupBy("path").applyInArrow(run, "path string, offset long, length long"), "warc-index")


def number(ident: str) -> int | None:
    """The page of a record's name."""
    page = ident.strip("<>").split(":")[2]
    return None if page == "None" else int(page)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Reads each member by its offset; page_id, payload_bytes, payload_digest, record_type, refers_to. Responses are verified."""

    def read(batches):
        store, _ = open_store(folder)
        at, src = None, None
        for b in slices(batches):
            rows = []
            for path, offset, length in zip(*(b.column(k).to_pylist() for k in range(3))):
                if path != at:
                    if src is not None:
                        src.close()
                    at, src = path, store.open_input_file(path)
                src.seek(offset)
                ((heads, block),) = records([zlib.decompress(src.read(length), GZIP)])
                digest, size = heads["WARC-Payload-Digest"].removeprefix("sha256:"), int(heads["WARC-Payload-Length"])
                if heads["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{heads['WARC-Record-ID']} in {path} isn't the payload that was written")
                refers = heads.get("WARC-Refers-To")
                rows.append((number(heads["WARC-Record-ID"]), size, digest, heads["WARC-Type"], number(refers) if refers else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if src is not None:
            src.close()

    return index.select("path", "offset", "length").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages, normalises the archives and reads them back. The monolithic archives go once they are normalised."""
    spark = pages.sparkSession
    raw, done = new_folder(spark, "warc-raw"), new_folder(spark, "warc")
    index = normalise_archives(revisits(write_monolithic(pages, raw)), done)
    remove(spark, raw)
    return read_back(index, done)
