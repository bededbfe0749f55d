"""Best-fit decreasing packing of token sequences.

Documents are tokenised, ended by id 0 and cut into pieces of at most ``capacity`` only where longer. Whole pieces fill a
sequence each; the others are dealt by hash into shards of bounded size, and each shard is packed best-fit decreasing: a
segment tree over the remaining capacities of open sequences finds the tightest one that fits in logarithmic time.

Null and empty texts are one piece holding id 0 alone. Repeated rows are packed each on its own. Of pieces of one length the
smaller doc_id goes first, and of bins with the same room any may be taken; how many there are doesn't hang on it. A null doc_id
is carried. Very long texts are encoded whole. Other columns, whatever their names, are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import array
import os
import re
import unicodedata
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

CAPACITY = 2048
#: Pieces that one task packs, in expectation. What shards leave open is at most a sequence or so each.
SHARD_PIECES = 40_000
#: Encoded words that a worker remembers.
MEMO_WORDS = 300_000
END = array.array("I", [0]).tobytes()


#: The characters that byte-level vocabularies write bytes as: printable ones as themselves, others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


_PLAIN = re.compile(rb"([a-z]+)([.,]?)")


class WordMemo:
    """Token ids, as little-endian unsigned 32-bit integers, of whole texts.

    The tokenizer cuts at white space first and ignores case, so a text's ids are those of its stretches between spaces and
    line ends with A-Z lower-cased; these are remembered: when half of MEMO_WORDS are, they become the old ones, of which those
    seen again are kept. Only text that may spell a special token keeps its case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.old = Tokenizer.from_file(path), {b"": b""}, {}
        self.marks = {b"": b""} | {m.encode(): self.whole([m])[0] for m in (".", ",")}

    def whole(self, words: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Remembers words. Letters, maybe with a point or comma behind, are one word to the tokenizer's model, which knows no capitals."""
        hard, merge, memo, plain = [], self.tokenizer.model.tokenize, self.memo, _PLAIN.fullmatch
        for w in words:
            if found := plain(w):
                letters, mark = found.groups()
                ids = memo.get(letters)
                if ids is None:
                    memo[letters] = ids = array.array("I", [t.id for t in merge(letters.decode())]).tobytes()
                memo[w] = ids + self.marks[mark]
                continue
            text = w.decode()
            mark = self.marks.get(w[-1:], b"")
            letters = text[:-1] if mark else text
            if letters.isalpha() and (letters.isascii() or (unicodedata.is_normalized("NFC", letters) and letters.lower() == letters)):
                spelled = letters.lower() if letters.isascii() else "".join(map(_BYTE.__getitem__, letters.encode()))
                memo[w] = array.array("I", [t.id for t in merge(spelled)]).tobytes() + mark
            else:
                hard.append(w)
        for k in range(0, len(hard), 20_000):
            part = hard[k : k + 20_000]
            memo.update(zip(part, self.whole([w.decode() for w in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            b = t.encode("utf-8").replace(b"\n", b" ")
            split.append((b if b"<|" in b else b.lower()).split(b" "))
        new = set()
        for words in split:
            new.update(words)
        fresh = new.difference(self.memo)
        if len(self.memo) + len(fresh) > MEMO_WORDS // 2:
            self.old, self.memo = self.memo, {b"": b""}
            fresh = new - {b""}
        memo = self.memo
        again = {w: self.old[w] for w in fresh if w in self.old}
        memo.update(again)
        self.learn(fresh.difference(again))
        get = memo.__getitem__
        return [b"".join(map(get, words)) for words in split]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; salt: a number that deals pieces out evenly."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def cut(batches):
        from pyspark import TaskContext

        memo, count, task = WordMemo(path), 0, TaskContext.get().partitionId()
        for b in slices(batches, 200):
            ids, texts = (b.column(k).to_pylist() for k in range(2))
            rows = []
            for doc, body in zip(ids, memo.encode([t or "" for t in texts])):
                body += END
                for k, at in enumerate(range(0, len(body), 4 * capacity)):
                    part = body[at : at + 4 * capacity]
                    count += 1
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), zlib.crc32(b"%d %d" % (task, count))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


class TightestBin:
    """Open bins by remaining capacity under a segment tree of the largest non-empty capacity, found from below."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)  # whether a node's range of capacities has an open bin
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        k, some = room + self.size, self.some
        while k and not some[k]:
            some[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest open bin with room for ``need``, removed; None where no bin has."""
        some, k = self.some, need + self.size
        if not some[k]:
            while k > 1 and not (k & 1 == 0 and some[k + 1]):  # up to the first right neighbour that has one
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if some[2 * k] else 2 * k + 1
        room = k - self.size
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            some[k] = 0
            k >>= 1
            while k and not (some[2 * k] or some[2 * k + 1]):
                some[k] = 0
                k >>= 1
        return room, bin_


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item, the items taken by decreasing length."""
    free, bins, offsets, used = TightestBin(capacity), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        found = free.take(need)
        if found is None:
            room, bin_ = capacity, used
            used += 1
        else:
            room, bin_ = found
        bins[i], offsets[i] = bin_, capacity - room
        if room > need:
            free.put(room - need, bin_)
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    cut = staged(pieces(docs, capacity, tokenizer), "pieces")
    count = cut.where(F.col("length") < capacity).count()
    shards = max(1, -(-count // shard_pieces))

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        bins, offsets = best_fit(part["length"].to_pylist(), capacity)
        shard = part["shard"][0].as_py()
        part = part.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        part = part.append_column("sequence_id", pa.array([b * shards + shard for b in bins], pa.int64()))
        return part.append_column("offset", pa.array(offsets, pa.int64()))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    part = cut.where(F.col("length") < capacity).withColumn("shard", F.pmod("salt", F.lit(shards))).groupBy("shard").applyInArrow(fill, schema)
    whole = cut.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return part.unionByName(whole)
