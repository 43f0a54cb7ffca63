"""Token-id output by plane shuffling: fixed-size id blocks, transposed into byte planes, each compressed by zstandard.

The files are Parquet parts used as containers, so Spark's committer makes each part appear whole or not at all and any
store that Spark writes will do. One row is one chunk: the compressed planes, and the chunk index (first id, number of
ids, plane sizes in bytes, crc32 of the ids, and which documents the ids belong to).
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections import deque
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tideline.llm import text as T
from tideline.session import shared_folder

CHUNK_IDS = 1 << 16
WIDTH = 4
LEVEL = 3

CHUNKS = ("part int, chunk long, first long, n_ids int, crc32 long, plane_bytes array<int>, planes array<binary>, "
          "doc_id array<long>, doc_first array<long>, doc_ids array<long>, doc_whole array<long>")
_CHUNKS = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()), ("crc32", pa.int64()),
                     ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary())), ("doc_id", pa.list_(pa.int64())),
                     ("doc_first", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("doc_whole", pa.list_(pa.int64()))])


def encode_planes(ids: np.ndarray, compressor: zstandard.ZstdCompressor | None = None) -> list[bytes]:
    """Byte planes of little-endian unsigned 32-bit ids, low byte first, each compressed on its own."""
    compressor = compressor or zstandard.ZstdCompressor(level=LEVEL)
    planes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, WIDTH).T
    return [compressor.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def decode_planes(planes: list[bytes], n: int, decompressor: zstandard.ZstdDecompressor | None = None) -> np.ndarray:
    decompressor = decompressor or zstandard.ZstdDecompressor()
    out = np.empty((n, WIDTH), np.uint8)
    for i, p in enumerate(planes):
        out[:, i] = np.frombuffer(decompressor.decompress(p, max_output_size=max(n, 1)), np.uint8)
    return out.reshape(-1).view("<u4")


# The splitter's class of each byte that stands for itself: letters, digits, marks, separators; 0: others, and what opens a contraction or special token.
_CLASS = np.zeros(256, np.int8)
_CLASS[0x21:0x7F] = 3
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[list(T.SEPARATORS)] = 4
_CLASS[[0x27, 0x3C]] = 0
# Second bytes of the letters U+00C0 to U+00FF, after 0xC3.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
# The vocabulary's character for each byte, as the byte-level splitter writes it.
_CHARACTER = np.arange(256, dtype="<u4")
_CHARACTER[[b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]] = np.arange(256, 324)
LONG = 1000
SLOT_BITS = 20
_CHECK = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def characters(data: np.ndarray) -> str:
    """What the vocabulary writes for the bytes, one character each."""
    return _CHARACTER[data].tobytes().decode("utf-32-le")


NOTHING = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def merged(table: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both tables of ascending keys and their numbers as one."""
    at = np.searchsorted(table[0], new[0])
    return np.insert(table[0], at, new[0]), np.insert(table[1], at, new[1])


def grown(own: np.ndarray, size: int) -> np.ndarray:
    """``own`` with room for ``size`` entries; the room is not written, so it takes no memory until it is used."""
    out = np.empty(size, own.dtype)
    out[:len(own)] = own
    return out


class WordEncoder:
    """Encodes by the tokenizer, remembering the ids of pieces of text that it encodes on their own.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its words in order. A word of
    only Latin-1 letters, ASCII digits and marks is lower-cased and cut as its splitter does, and the tokenizer's model gives the ids of
    each piece; so it does for other Latin letters with closing commas and stops. Other words pass the whole tokenizer.
    Pieces are found by a 64-bit hash in a table of those met last, else in a sorted array, new ones in a small one that is merged into it when
    it has grown to a quarter of it, and checked by a second hash. The memory, some 60 bytes a piece, is cleared when it holds ``keep`` pieces.
    """

    def __init__(self, path: str, keep: int = 1_500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.tables = [NOTHING, NOTHING]  # old and recent: ascending keys, and the numbers of their pieces
        self.slot = np.zeros(1 << SLOT_BITS, np.int64)  # a piece for each start of a key, mostly the one met last
        self.key = np.zeros(1024, np.uint64)
        self.check = np.zeros(1024, np.uint64)
        self.at = np.zeros(1025, np.int64)
        self.pool = np.zeros(4096, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's piece; -1: not known."""
        out = np.full(len(keys), -1)
        for own, number in self.tables:
            left = np.flatnonzero(out < 0)
            if len(own) and len(left):
                at = np.minimum(np.searchsorted(own, keys[left]), len(own) - 1)
                out[left] = np.where(own[at] == keys[left], number[at], -1)
        return out

    @staticmethod
    def entries(piece: str) -> tuple[str, ...]:
        """The splitter's entries of Latin letters with or without closing commas and stops, lower-cased; none if not of this form."""
        stem = piece.rstrip(".,")
        if not stem or len(piece) > LONG or not stem.isalpha() or not (stem.isascii() or (
                max(stem) < "\u0250" and unicodedata.is_normalized("NFC", stem) and stem.lower().isalpha())):
            return ()
        low = characters(np.frombuffer(stem.lower().encode(), np.uint8))
        return (low, piece[len(stem):]) if len(stem) < len(piece) else (low,)

    def fresh_ids(self, pieces: list[str], plain: list[bool]) -> list[list[int]]:
        """Ids of each piece; ``plain`` ones are entries of the splitter."""
        tokenize = self.model.tokenize
        ids, rest = [], []
        for i, (piece, whole) in enumerate(zip(pieces, plain, strict=True)):
            if whole:
                ids.append([t.id for t in tokenize(piece)])
                continue
            parts = self.entries(piece)
            ids.append([t.id for part in parts for t in tokenize(part)])
            if not parts:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        return ids

    def learn(self, keys: np.ndarray, check: np.ndarray, pieces: list[str], plain: list[bool]) -> None:
        """Add pieces; ``keys`` ascend and are new."""
        n = self.known
        for i in range(0, len(pieces), 10_000):
            ids = self.fresh_ids(pieces[i:i + 10_000], plain[i:i + 10_000])
            m = len(ids)
            size = np.fromiter(map(len, ids), np.int64, m)
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
            if n + m + 1 > len(self.at):
                self.key = grown(self.key, 2 * (n + m))
                self.check = grown(self.check, 2 * (n + m))
                self.at = grown(self.at, 2 * (n + m) + 1)
            top = int(self.at[n]) if n else 0
            if top + len(flat) > len(self.pool):
                self.pool = grown(self.pool, 2 * (top + len(flat)))
            self.pool[top:top + len(flat)] = flat
            self.at[n] = top
            self.at[n + 1:n + m + 1] = top + np.cumsum(size)
            self.key[n:n + m] = keys[i:i + m]
            self.check[n:n + m] = check[i:i + m]
            n += m
        old, recent = self.tables
        recent = merged(recent, (keys, np.arange(self.known, n)))
        self.tables = [old, recent] if 4 * len(recent[0]) < len(old[0]) else [merged(old, recent), NOTHING]
        self.known = n

    def pieces(self, block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every piece, the bytes with plain words lower-cased, and which bytes are in plain words."""
        data = block.data
        w = T.spans(data, block.bounds)
        kind = _CLASS[data]
        second = np.zeros(len(data), bool)
        second[1:] = _SECOND[data[1:]] & (data[:-1] == 0xC3)
        kind[second] = 1
        kind[:-1][second[1:]] = 1
        plain = np.ones(len(w.start), bool)
        plain[np.searchsorted(w.start, np.flatnonzero(kind == 0), "right") - 1] = False
        edge = np.zeros(len(data) + 1, np.int8)
        edge[w.start[plain]] += 1
        edge[w.end[plain]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        lower = T.LOWER[data]
        lower[second & (data < 0x9F)] += 32
        turn = (kind[1:] != kind[:-1]) | (kind[1:] == 2)  # every digit is an entry of its own
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = turn & inside[1:] & inside[:-1]
        end = start.copy()
        start[w.start], end[w.end] = True, True
        return np.flatnonzero(start), np.flatnonzero(end), np.where(inside, lower, data), inside

    def __call__(self, block: T.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts in one array, and the bounds of the texts in it."""
        start, end, data, inside = self.pieces(block)
        rows = len(block.bounds) - 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        key, check = T.span_hash(T.BYTE_VALUE[data], start, end), T.span_hash(_CHECK[data], start, end)
        slot = key >> np.uint64(64 - SLOT_BITS)
        index = self.slot[slot]
        miss = np.flatnonzero(self.key[index] != key)
        unique, first, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
        number = self.find(unique)
        fresh = np.flatnonzero(number < 0)
        if self.known + len(fresh) > self.keep:
            self.clear()
            miss = np.arange(len(key))
            unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            fresh = np.arange(len(unique))
        if len(fresh):
            where = miss[first[fresh]]
            raw, text = data.tobytes(), characters(data)
            x, y = start[where], end[where]
            plain = (inside[x] & (y - x <= LONG)).tolist()
            self.learn(unique[fresh], check[where], [text[i:j] if whole else raw[i:j].decode("utf-8", "replace")
                                                     for i, j, whole in zip(x.tolist(), y.tolist(), plain, strict=True)], plain)
            number = self.find(unique)
        index[miss] = number[inverse]
        self.slot[slot[miss]] = index[miss]
        size, begin = self.at[index + 1] - self.at[index], self.at[index]
        last = np.cumsum(size)
        take = np.arange(int(last[-1])) + np.repeat(begin - (last - size), size)
        ids = self.pool[take]
        bounds = np.concatenate([[0], last])[np.searchsorted(start, block.bounds)]
        clash = np.flatnonzero(self.check[index] != check)
        if len(clash):  # two pieces with one hash: encode the affected texts on their own
            hit = np.unique(np.searchsorted(block.bounds, start[clash], "right") - 1)
            texts = [bytes(block.data[block.bounds[r]:block.bounds[r + 1]]).decode("utf-8", "replace") for r in hit]
            own = {int(r): np.array(e.ids, np.uint32) for r, e in
                   zip(hit, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True)}
            parts = [own.get(r, ids[bounds[r]:bounds[r + 1]]) for r in range(rows)]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


_encoders: dict[str, WordEncoder] = {}


def vocabulary_encoder(path: str) -> Callable[[], WordEncoder]:
    """One encoder per Python worker, so later tasks find the pieces of earlier ones."""
    def make() -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]
    return make


def _writer(make: Callable[[], Callable[[T.Block], tuple[np.ndarray, np.ndarray]]], end_id: int):
    def run(batches):
        from pyspark import TaskContext

        encode = make()
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        part = TaskContext.get().partitionId()
        held: deque = deque()  # doc_id, the ids not yet written, how many were written
        size = first = chunk = 0

        def take(n: int) -> pa.RecordBatch:
            nonlocal size, first, chunk
            pieces, got = [], 0
            while got < n:
                doc, ids, done = held.popleft()
                now = ids[:n - got]
                pieces.append((doc, now, done, done + len(ids)))
                if len(now) < len(ids):
                    held.appendleft((doc, ids[len(now):], done + len(now)))
                got += len(now)
            ids = np.concatenate([p[1] for p in pieces]).astype("<u4")
            planes = encode_planes(ids, compressor)
            row = {"part": part, "chunk": chunk, "first": first, "n_ids": n, "crc32": zlib.crc32(ids), "planes": planes,
                   "plane_bytes": [len(p) for p in planes], "doc_id": [p[0] for p in pieces], "doc_first": [p[2] for p in pieces],
                   "doc_ids": [len(p[1]) for p in pieces], "doc_whole": [p[3] for p in pieces]}
            first, chunk, size = first + n, chunk + 1, size - n
            return pa.RecordBatch.from_pylist([row], schema=_CHUNKS)

        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for block in T.blocks(batch, limit=T.BLOCK_BYTES // 2):
                ids, bounds = encode(block)
                for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    held.append((names[block.lo + i], np.append(ids[lo:hi], np.uint32(end_id)), 0))
                    size += hi - lo + 1
                while size >= CHUNK_IDS:
                    yield take(CHUNK_IDS)
        if size:
            yield take(size)
    return run


def write_planes(docs: DataFrame, path: str, make_encoder: Callable[[], Callable[[T.Block], tuple[np.ndarray, np.ndarray]]], end_id: int = 2) -> None:
    """Encode texts (null: empty), append ``end_id`` to each, and write the ids in ascending doc_id order.

    The order is that of the parts by number and of the chunks within a part. Texts, not ids, are range-partitioned by
    doc_id, so the shuffle moves each text once; rows with an equal doc_id keep together but in no particular order, rows
    with a null doc_id come first. ``make_encoder`` is called once per task.
    """
    spark = docs.sparkSession
    # Many small ranges: one huge text or a run of long ones must not fill a task.
    ranges = max(32, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    (docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(_writer(make_encoder, end_id), CHUNKS)
     .write.mode("errorifexists").option("compression", "uncompressed").parquet(path))


PIECES = "part int, first long, doc_id long, doc_first long, n long, whole long, crc long, ids binary"


def _reader(batches):
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("doc_first", pa.int64()), ("n", pa.int64()),
                        ("whole", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
    decompressor = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            raw = decode_planes(row["planes"], row["n_ids"], decompressor).tobytes()
            if zlib.crc32(raw) != row["crc32"]:
                raise ValueError(f"chunk {row['part']}/{row['chunk']} does not match its checksum")
            rows, at = [], 0
            for doc, done, n, whole in zip(row["doc_id"], row["doc_first"], row["doc_ids"], row["doc_whole"], strict=True):
                ids = raw[at * WIDTH:(at + n) * WIDTH]
                cut = n < whole
                rows.append({"part": row["part"], "first": row["first"] + at - done, "doc_id": doc, "doc_first": done, "n": n, "whole": whole,
                             "crc": None if cut else zlib.crc32(ids), "ids": ids if cut else None})
                at += n
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every document's pieces: where it starts within its part, its ids' checksum, and the ids of documents cut by a chunk end."""
    return spark.read.schema(CHUNKS).parquet(path).mapInArrow(_reader, PIECES)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32, from the files alone.

    Only documents cut by a chunk end are gathered, each one's own pieces in one row. Offsets of parts come from a running sum
    over one row per part.
    """
    pieces = read_pieces(spark, path)
    cut = (pieces.where("ids is not null").groupBy("part", "first", "doc_id", "whole")
           .agg(F.array_sort(F.collect_list(F.struct("doc_first", "ids"))).alias("p"))
           .select("part", "first", "doc_id", "whole", F.crc32(F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")).alias("crc")))
    every = pieces.where("ids is null").select("part", "first", "doc_id", "whole", "crc").unionByName(cut)
    parts = spark.read.schema(CHUNKS).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("ids"))
    offsets = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("offset"))
    return every.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("first")).alias("start"), F.col("whole").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def encode_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` into a new folder of the shared one, read them back, return the digests."""
    path = f"{shared_folder(docs.sparkSession)}/planes-{uuid.uuid4().hex}"
    write_planes(docs, path, vocabulary_encoder(tokenizer_path), end_id)
    return digests(docs.sparkSession, path)
