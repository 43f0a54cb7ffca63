"""Vector code compression by per-dimension value dictionaries.

Vectors are scaled to integers and cut into equal consecutive parts; each part position has a codebook of a few entries,
refined by rounds of assignment and averaging in exact integer arithmetic. In a block of vectors every dimension gets
the dictionary of its distinct integers; the squared differences of each dictionary value to all entries are tabulated
once, and the distance of a part to all entries is a gather of those table rows, added over the part's dimensions.

Defined cases: a null vector, or one with a null, NaN or infinite component, is dropped, and so is one whose length differs
from that of the smallest kept id (ties: the smallest integers), as some position has no component there. Repeated rows count
each; equal ids are ordered by their integers, null ids come last. With fewer vectors than entries the codebooks are shorter; an empty table
gives no rows. Columns besides the named ones are ignored, whatever their names. Magnitudes of 2**15 or more raise an error,
since sums of squares could leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline.session import durable

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 8192
LARGEST = 1 << 27


class Codes(NamedTuple):
    """Rows (vec_id, label, code, error) and the final codebooks: integers [part][entry][position]."""

    rows: DataFrame
    codebooks: np.ndarray


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def whole(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def part_distances(block: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance of each part (n, width) to each entry (m, width), from value dictionaries."""
    total = np.zeros((len(block), len(book)), np.int64)
    for j in range(block.shape[1]):
        values, codes = np.unique(block[:, j], return_inverse=True)
        table = values[:, None] - book[None, :, j]
        total += (table * table)[codes]
    return total


def blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers (n, dims)) of consecutive rows."""
    column = batch.column(batch.schema.get_field_index("vector"))
    for lo in range(0, len(column), BLOCK):
        part = column.slice(lo, BLOCK)
        yield lo, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)


def assigned(block: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its integers, nearest entry, squared distance); ties go to the lower entry."""
    width = books.shape[2]
    for part, book in enumerate(books):
        own = block[:, part * width:(part + 1) * width]
        far = part_distances(own, book)
        entry = far.argmin(1)
        yield part, own, entry, far[np.arange(len(own)), entry]


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floored mean of its parts; an unused entry stays.

    Every task adds up its blocks, so a few rows per task are shuffled, and parts x entries x width rows are collected.
    """
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, block in blocks(batch, parts * width):
                for part, own, entry, _ in assigned(block, books):
                    chosen = (entry == np.arange(entries)[:, None]).astype(np.int64)
                    total[part] += chosen @ own
                    count[part] += chosen.sum(1)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(part.repeat(width)), pa.array(entry.repeat(width)), pa.array(np.tile(np.arange(width), len(part))),
            pa.array(total[part, entry].ravel()), pa.array(count[part, entry].repeat(width))], ["part", "entry", "position", "total", "n"])

    per_task = vectors.select("vector").mapInArrow(sums, "part long, entry long, position long, total long, n long")
    out = books.copy()
    for r in per_task.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return out


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", *, scale: int = SCALE,
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes (two hex digits for each part) and total squared errors of all whole vectors, with the codebooks they refer to."""
    kept = durable(vectors.where(whole(F.col(vector))).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), scaled(F.col(vector), scale).alias("vector")))
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    shape = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    lead = kept.where(F.size("vector") > 0).orderBy(*order).limit(1).collect()
    if not lead:
        return Codes(kept.sparkSession.createDataFrame([], shape), np.zeros((parts, 0, 0), np.int64))
    dims = len(lead[0]["vector"])
    if dims % parts:
        raise ValueError(f"{dims} dimensions cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("vector") == dims)
    if kept.agg(F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))).first()[0] >= LARGEST:
        raise ValueError(f"a scaled component has a magnitude of {LARGEST} or more")
    first = np.array([r["vector"] for r in kept.orderBy(*order).limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, dims // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refined(kept, books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, block in blocks(batch, dims):
                codes, error = np.empty((len(block), parts), np.uint8), np.zeros(len(block), np.int64)
                for part, _, entry, far in assigned(block, books):
                    codes[:, part] = entry
                    error += far
                text = codes.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(lo, len(block)) for i in range(2)),
                    pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)], shape.names)

    return Codes(kept.select("vec_id", "label", "vector").mapInArrow(final, shape), books)


def digest(codebooks: np.ndarray) -> str:
    """sha256 of all entries' integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); label_error adds the errors of equal labels, null labels together.

    The label totals are written before they are joined back, so the rows of a frequent label can be split over tasks.
    """
    found = encode(vectors, vec_id, vector, label)
    rows = durable(found.rows)
    totals = durable(rows.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    return rows.join(totals, rows["label"].eqNullSafe(totals["_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(found.codebooks)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``compressed`` over ``embeddings``: the same rounds, as one common table each."""
    nearest = """a{r} as materialized (select vec_id, label, part, arg_min(entry, {entries} * d + entry) as entry, min(d) as d from (
  select v.vec_id, v.label, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) as d from v join b{r} b using (part, pos)
  group by all) group by all)"""
    means = """b{next} as materialized (select b.part, b.entry, b.pos, coalesce(s.x, b.x) as x from b{r} b left join (
  select part, entry, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x
  from v join a{r} using (vec_id, part) group by all) s using (part, entry, pos))"""
    steps = [nearest.format(r=r, entries=entries) + ",\n" + means.format(r=r, next=r + 1) for r in range(rounds)]
    return f"""
with kept as (select vec_id, label, embedding as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select vec_id, label, i // (n // {parts}) as part, i % (n // {parts}) as pos, floor({SCALE} * e[i + 1]::double)::bigint as x
  from (select *, len(e) as n, unnest(range(len(e))) as i from kept)),
b0 as (select part, entry, pos, x from v join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {entries}) using (vec_id)),
{",".join(steps)},
{nearest.format(r=rounds, entries=entries)},
o as (select vec_id, label, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by all)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) from b{rounds}) as codebooks_sha256 from o"""
