"""Exact removal of repeated byte strings by bucket-pointer refinement.

Sorting all suffixes is not needed to find strings of ``LENGTH`` bytes that start twice. The start positions are put into buckets by
the id of one q-gram each (the *pointer*): the q-gram with the least hash among those that begin in the first ``LENGTH - Q + 1``
positions of the string. Equal strings have equal pointers at equal distances, so a string's twin is in its own bucket. Buckets
are then refined level by level, each level sorting on the identifiers (64-bit hashes) of longer stretches that follow at set
offsets from the pointer, and only buckets that are still mixed are refined again:

* level 0: one entry per pointer occurrence, with the stretch of all its starts (some 120 of them) as one identifier; an entry whose
  bucket or whose identifier occurs once, or only together, is settled for all its starts;
* level 1: aligned runs of ``RUN`` starts, for one representative of each identifier in a mixed bucket. A run is bucketed by its
  *core*, the bytes that all its strings share: a core that occurs once settles that none of them has a twin;
* level 2: single starts, for one representative of each identifier of the runs still mixed.

What an earlier level settled is reused: its representative alone stands for all occurrences in the later ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm import text as T
from tideline.session import durable

LENGTH = 400
Q = 160
SPAN = LENGTH - Q + 1
RUN = 8
_U = np.uint64

ENTRIES = "doc_id long, bucket long, ident long, place long"
_ENTRIES = pa.schema([("doc_id", pa.int64()), ("bucket", pa.int64()), ("ident", pa.int64()), ("place", pa.int64())])


class Hasher:
    """Hashes of stretches of one block's bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = T.powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(T.BYTE_VALUE[data] * self.up[:-1], out=self.total[1:])

    def raw(self, start, end) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return T.mix(self.raw(start, end) + (end - start).astype(np.uint64) * T._STEP)


def pointers(block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hasher]:
    """Row, pointer position and first and last start of every entry, as positions in the block."""
    h = Hasher(block.data)
    n = len(block.data) - Q + 1
    if n < SPAN:
        none = np.zeros(0, np.int64)
        return none, none, none, none, h
    at = np.arange(n)
    gram = T.mix((h.total[Q:] - h.total[:n]) * h.down[:n])
    least = (gram >> _U(32) << _U(32)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if SPAN > width:
        least = np.minimum(least[:len(least) - (SPAN - width)], least[SPAN - width:])
    pointer = (least & _U(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(len(pointer) + 1, np.int8)  # starts whose string ends within the text
    size = np.diff(block.bounds)
    long = size >= LENGTH
    np.add.at(ok, block.bounds[:-1][long], 1)
    np.add.at(ok, block.bounds[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8) > 0)
    pointer = pointer[starts]
    row = np.searchsorted(block.bounds, starts, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (pointer[1:] != pointer[:-1]) | (row[1:] != row[:-1])])) if len(starts) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(starts)) - 1 if len(new) else new
    return row[new], pointer[new], starts[new], starts[last], h


def pack(first: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    """First start within the text, pointer distance from it, and number of further starts, in one long."""
    return first << 20 | before << 10 | more


def _entries(batches):
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for block in T.blocks(batch):
            row, pointer, first, last, h = pointers(block)
            bucket = T.mix(h.raw(pointer, pointer + Q) + _U(77))
            ident = T.mix(h(first, last + LENGTH) + ((pointer - first) << 10 | (last - first)).astype(np.uint64) * T._STEP)
            yield pa.RecordBatch.from_arrays([
                ids.slice(block.lo, block.hi - block.lo).take(pa.array(row)), pa.array(bucket.view(np.int64)), pa.array(ident.view(np.int64)),
                pa.array(pack(first - block.bounds[row], pointer - first, last - first))], schema=_ENTRIES)


def place_column(at: Column) -> tuple[Column, Column]:
    """First start and number of further starts of a packed place."""
    return F.shiftright(at, 20), at.bitwiseAND(1023)


SNIPPETS = "rep long, doc_id long, bucket long, weight long, place long, bytes binary"


def _snippets(batches):
    """Cuts each representative's bytes (all its starts' strings) out of its text."""
    schema = pa.schema([("rep", pa.int64()), ("doc_id", pa.int64()), ("bucket", pa.int64()), ("weight", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
    for batch in batches:
        data, bounds = T.byte_column(batch, "text")
        ids, wanted = batch.column(0).to_pylist(), batch.column(batch.schema.get_field_index("wanted")).to_pylist()
        rows = []
        for i, (doc, want) in enumerate(zip(ids, wanted, strict=True)):
            for w in want:
                first, more = w["place"] >> 20, w["place"] & 1023
                lo = bounds[i] + first
                rows.append({"rep": w["ident"], "doc_id": doc, "bucket": w["bucket"], "weight": w["weight"], "place": w["place"],
                             "bytes": data[lo:lo + more + LENGTH].tobytes()})
        for lo in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist(rows[lo:lo + 4096], schema=schema)


RUNS = "rep long, weight long, core long, ident long, k int, doc_id long, first long, count int"
STARTS = "string long, doc_id long, start long, open boolean"


def _batched(batch: pa.RecordBatch):
    """Bytes of all snippets, their bounds, pointer distance and start counts."""
    column = batch.column(batch.schema.get_field_index("bytes")).cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    place = batch.column(batch.schema.get_field_index("place")).to_numpy()
    return data, bounds[:-1] - bounds[0], place >> 20, (place >> 10) & 1023, place & 1023


def _runs(batches):
    schema = pa.schema([("rep", pa.int64()), ("weight", pa.int64()), ("core", pa.int64()), ("ident", pa.int64()), ("k", pa.int32()), ("doc_id", pa.int64()),
                        ("first", pa.int64()), ("count", pa.int32())])
    for whole in batches:
        for at in range(0, len(whole), 2048):
            batch = whole.slice(at, 2048)
            data, base, first, before, more = _batched(batch)
            h = Hasher(data)
            top, low = before // RUN, (before - more) // RUN  # distances of the first and the last start
            size = top - low + 1
            i = np.repeat(np.arange(len(batch)), size)
            k = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + low[i]
            a = np.maximum(before[i] - (k * RUN + RUN - 1), 0)  # first and last own start of the run, from the snippet's start
            b = np.minimum(before[i] - k * RUN, more[i])
            core = h(base[i] + before[i] - k * RUN, base[i] + before[i] - (k * RUN + RUN - 1) + LENGTH)
            bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy().view(np.uint64)[i]
            core = T.mix(core + bucket + k.astype(np.uint64) * T._STEP)
            ident = T.mix(h(base[i] + a, base[i] + b + LENGTH) + core + ((before[i] - a) << 10 | (b - a)).astype(np.uint64) * T._STEP)
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), batch.column(3).take(take), pa.array(core.view(np.int64)), pa.array(ident.view(np.int64)), pa.array(k.astype(np.int32)),
                batch.column(1).take(take), pa.array(first[i] + a), pa.array((b - a + 1).astype(np.int32))], schema=schema)


def _strings(batches):
    schema = pa.schema([("string", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("open", pa.bool_())])
    for whole in batches:
        for at in range(0, len(whole), 2048):
            batch = whole.slice(at, 2048)
            data, base, first, before, more = _batched(batch)
            h = Hasher(data)
            runs = batch.column(batch.schema.get_field_index("ks"))
            i = np.repeat(np.arange(len(batch)), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            k, open_ = flat.field(0).to_numpy().astype(np.int64), np.asarray(flat.field(1))
            step = np.tile(np.arange(RUN), len(k))
            i, k, open_ = np.repeat(i, RUN), np.repeat(k, RUN), np.repeat(open_, RUN)
            s = before[i] - (k * RUN + step)
            ok = (s >= 0) & (s <= more[i])
            i, s, open_ = i[ok], s[ok], open_[ok]
            bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy().view(np.uint64)[i]
            string = T.mix(h(base[i] + s, base[i] + s + LENGTH) + bucket)
            yield pa.RecordBatch.from_arrays([pa.array(string.view(np.int64)), batch.column(1).take(pa.array(i)), pa.array(first[i] + s), pa.array(open_)], schema=schema)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last): runs of start positions whose ``LENGTH``-byte string also starts elsewhere. Runs may touch."""
    docs = docs.select("doc_id", "text")
    entries = durable(docs.mapInArrow(_entries, ENTRIES))
    # Written first, so that both sides of the joins are plain shuffles: Spark can then split a hot bucket.
    buckets = durable(entries.groupBy("bucket").agg(F.count("*").alias("c"), (F.min("ident") != F.max("ident")).alias("mixed")).where("c > 1")
                      .select("bucket", "mixed"))
    twins = durable(entries.join(buckets, "bucket"))
    classes = twins.where("mixed").groupBy("bucket", "ident").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "place")).alias("at"))
    classes = durable(classes.select("bucket", "ident", "weight", "at.doc_id", "at.place"))
    first, more = place_column(F.col("place"))
    settled = (twins.where("not mixed").select("doc_id", first.alias("first"), (first + more).alias("last"))
               .unionByName(twins.where("mixed").join(classes.where("weight > 1").select("bucket", "ident"), ["bucket", "ident"]).select(
                   "doc_id", first.alias("first"), (first + more).alias("last"))))

    wanted = classes.groupBy("doc_id").agg(F.collect_list(F.struct("ident", "bucket", "weight", "place")).alias("wanted"))
    snippets = durable(docs.dropDuplicates(["doc_id"]).join(wanted.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")))
                       .select("doc_id", "text", "wanted").mapInArrow(_snippets, SNIPPETS))
    runs = durable(snippets.mapInArrow(_runs, RUNS))
    cores = durable(runs.groupBy("core").agg(F.count("*").alias("c"), (F.min("ident") != F.max("ident")).alias("mixed")).where("c > 1")
                    .select("core", "mixed"))
    paired = durable(runs.join(cores, "core"))
    same = paired.groupBy("core", "ident").agg(F.count("*").alias("c"), F.min(F.struct("rep", "k")).alias("at"), F.min("weight").alias("least"), F.max("mixed").alias("mixed"))
    same = durable(same.select("core", "ident", "c", "at.rep", "at.k", "mixed", ((F.col("c") == 1) & (F.col("least") == 1)).alias("open")))
    level1 = paired.where("weight = 1").join(same.where("c > 1").select("core", "ident"), ["core", "ident"]).select(
        "doc_id", "first", (F.col("first") + F.col("count") - 1).alias("last"))

    ks = same.where("mixed").groupBy("rep").agg(F.collect_list(F.struct("k", "open")).alias("ks"))
    strings = durable(snippets.join(ks, "rep").select("rep", "doc_id", "bucket", "weight", "place", "bytes", "ks").mapInArrow(_strings, STARTS))
    twice = strings.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select("string")
    level2 = strings.where("open").join(twice, "string").select("doc_id", F.col("start").alias("first"), F.col("start").alias("last"))
    return settled.unionByName(level1).unionByName(level2)


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(keep_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                        ("kept", pa.binary() if keep_text else pa.null())])

    def run(batches):
        for batch in batches:
            data, bounds = T.byte_column(batch, "text")
            spans = batch.column(batch.schema.get_field_index("spans"))
            rows = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = data[bounds[i]:bounds[i + 1]]
                merged: list[list[int]] = []
                own = spans[i].values
                if own is not None and len(own):
                    lo, hi = own.field(0).to_numpy(), own.field(1).to_numpy() + LENGTH
                    order = np.argsort(lo)
                    for a, b in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(text[at:a].tobytes())
                    at = b
                kept = b"".join([*kept, text[at:].tobytes()])
                rows.append({"doc_id": doc, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(merged),
                             "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if keep_text else None})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes) of every row of ``docs``.

    Every byte covered by a ``LENGTH``-byte string that also starts elsewhere, in the same document or another, is removed. A null
    text is empty. ``doc_id`` names the text: rows with an equal doc_id are copies (and so repeat each other). Null
    doc_ids are kept, taken as one name. Equality of strings is by 64-bit hashes of a common bucket. Spans are gathered per document, so
    memory is bounded by the longest one. Other columns are not read.
    """
    spans = repeated_starts(docs).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans")).withColumnRenamed("doc_id", "_doc")
    joined = docs.select("doc_id", "text").join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "spans")
    kind = DIGESTS.replace("kept string", "kept binary" if keep_text else "kept void")
    out = joined.mapInArrow(_cut(keep_text), kind)
    return out if keep_text else out.drop("kept")
