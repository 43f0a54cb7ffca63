"""N-gram Jaccard join by a token-group matrix.

Documents are sets of distinct k-word shingles (64-bit hashes). Two sets link when their Jaccard similarity
reaches the threshold. The join is exact and never emits the pairs inside a group:

1. Equal sets collapse to one class, so groups of copies cost one row.
2. Each class gets *part signatures*: the hash space is cut into ``m`` parts, a signature is the hash of all
   shingles that fall into one part. Linked sets differ in at most ``D = 2 u (100-J)/(100+J)`` shingles (``u``: the
   largest size of their size range), so they agree on at least ``m - D`` parts. A class therefore needs
   ``r = m - D - (its empty parts)`` shared signatures, and only its rarest ``all - r + 1`` signatures have to be indexed.
3. Classes are partitioned into groups of similar documents, by the class with which they share most signatures. Large
   groups are salted into blocks of bounded size.
4. A query is bound against a block first by shared signatures, then by the block's *token union*: a set of which fewer than
   J % of the shingles occur in the union cannot link to any member. Only qualifying queries open a block, where
   overlaps are exact counts (products of 0/1 matrices). A block yields a spanning forest of its links.
5. Connected components over these edges give the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from tideline.llm import graph, text as T
from tideline.session import durable, forget, release_shuffles, together

RANGE = 1.5
BLOCK_DOCS = 1024
BLOCK_TOKENS = 1 << 20
SLICES = 4  # of the signatures, shuffled one after the other
_U = np.uint64

SKETCH = "doc_id long, h long, n long, hi long, lo long, ranges array<struct<r: int, size: int, sigs: array<long>>>"


def size_edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RANGE)))
    return np.array(edges, np.int64)


def parts(top: int, percent: int) -> tuple[int, int]:
    """Largest symmetric difference of linked sets of at most ``top`` shingles, and the number of parts."""
    differ = 2 * top * (100 - percent) // (100 + percent)
    return differ, -(-(differ + 1) * 13 // 10)


def shingle_sets(block: T.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the bounds of the texts in them."""
    w = T.words(block, lower=True)
    hashes, at = T.grams(w, k)
    row = w.row[at]
    count = np.diff(w.first)
    for short in np.flatnonzero((count > 0) & (count < k)):  # fewer words: the whole sequence is one shingle
        own = w.hash[w.first[short]:w.first[short + 1]]
        whole = (own * T.powers(len(own))[0]).sum(keepdims=True) + _U(count[short])
        hashes, row = np.append(hashes, T.mix(whole)), np.append(row, short)
        order = np.argsort(row, kind="stable")
        hashes, row = hashes[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(count) + 1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[lo:hi].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(count) + 1))


def _sketch(percent: int, k: int):
    edges = size_edges()
    plan = {level: parts(int(edges[level + 1]) - 1, percent) for level in range(len(edges) - 1)}

    def signatures(one: np.ndarray, mixed: np.ndarray, level: int) -> dict:
        differ, m = plan[level]
        part = (((one >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
        edge = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])  # hashes ascend, so parts do
        key, sums = part[edge], np.add.reduceat(mixed, edge)
        need = len(edge) - differ
        if need < 1:  # could agree on empty parts alone: those count as signatures too
            empty = np.setdiff1d(np.arange(m), key)
            key, sums = np.append(key, empty), np.append(sums, np.zeros(len(empty), np.uint64))
            need = m - differ
        sig = T.mix(sums + key.astype(np.uint64) * T._STEP + _U((level + 1) * 0x9E3779B97F4A7C1 % 2**64))
        return {"r": need, "size": len(sig), "sigs": sig.view(np.int64)}

    def run(batches):
        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "h"))
            for block in T.blocks(batch):
                sets, bounds = shingle_sets(block, k)
                mixed = T.mix(sets ^ _U(0xA5A5A5A5A5A5A5A5))
                high, low = (T.row_sums(x, bounds).view(np.int64).tolist() for x in (mixed, T.mix(mixed)))
                rows = []
                for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    ranges = []
                    if hi > lo:
                        # its own size range, and those of the larger sets that it can link with
                        at, top = (int(np.searchsorted(edges, n, "right")) - 1 for n in (hi - lo, 100 * (hi - lo) // percent))
                        ranges = [signatures(sets[lo:hi], mixed[lo:hi], level) for level in range(at, top + 1)]
                    rows.append({"doc_id": ids[block.lo + i], "h": texts[block.lo + i], "n": hi - lo, "hi": high[i], "lo": low[i], "ranges": ranges})
                yield pa.RecordBatch.from_pylist(rows, schema=_SKETCH)
    return run


_SKETCH = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()),
                     ("ranges", pa.list_(pa.struct([("r", pa.int32()), ("size", pa.int32()), ("sigs", pa.list_(pa.int64()))])))])


def _tokens(k: int):
    schema = pa.schema([("cls", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for block in T.blocks(batch):
                sets, bounds = shingle_sets(block, k)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(block.lo, block.hi - block.lo), lists], schema=schema)
    return run


def linked_pairs(sets: list[np.ndarray], percent: int, query: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among ``sets`` (or only between queries and the others), as a spanning forest of index pairs.

    Token union bound: a set takes part only if J % of its shingles occur in the union of the others.
    """
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(flat, return_inverse=True)  # sorts
    left = np.arange(len(sets)) if query is None else np.flatnonzero(query)
    right = left if query is None else np.flatnonzero(~query)
    alive = np.ones(len(sets), bool)
    while True:
        live = alive[owner]
        if query is None:
            seen = np.bincount(token[live], minlength=token.max() + 1) >= 2
            shared = seen[token]
        else:
            has = [np.bincount(token[live & (query[owner] == side)], minlength=token.max() + 1) > 0 for side in (False, True)]
            shared = np.where(query[owner], has[0][token], has[1][token])
        bound = np.bincount(owner[shared & live], minlength=len(sets))
        now = alive & (100 * bound >= percent * size)
        if now.sum() == alive.sum():
            break
        alive = now
    left, right = left[alive[left]], right[alive[right]]
    if not len(left) or not len(right):
        return []
    use = shared & alive[owner]
    _, column = np.unique(token[use], return_inverse=True)
    member = owner[use]
    width = 4096
    overlap = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(sets), -1)
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width)) if len(column) else [0]
    for at, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        col, mem = column[x:y] - at * width, member[x:y]
        sides = []
        for side in ((left,) if query is None else (left, right)):
            place[:] = -1
            place[side] = np.arange(len(side))
            ok = place[mem] >= 0
            dense = np.zeros((len(side), width), np.float32)
            dense[place[mem[ok]], col[ok]] = 1
            sides.append(dense)
        overlap += sides[0] @ sides[-1].T
    total = size[left][:, None] + size[right][None, :] - overlap
    li, ri = np.nonzero(100 * overlap.astype(np.float64) >= percent * total)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for a, b in zip(left[li].tolist(), right[ri].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            forest.append((a, b))
    return forest


def _open(percent: int, queries: bool):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("cls").to_numpy()
        sets = [np.asarray(x.values, np.int64) for x in table.column("tokens").combine_chunks()] if len(ids) > 1 else []
        query = table.column("query").to_numpy() if queries else None
        pairs = linked_pairs(sets, percent, query) if sets else []
        return pa.table([pa.array([ids[x] for x, _ in pairs], pa.int64()), pa.array([ids[y] for _, y in pairs], pa.int64())], schema=schema)
    return run


def shared_signatures(rep: DataFrame) -> list[DataFrame]:
    """Signatures (sig, cls, r, size) that several sets have, with their number cnt; in ``SLICES`` written tables.

    A signature is counted and joined in the slice that its value belongs to, so the shuffles of one slice are on disk at a time.
    """
    signatures = rep.select("cls", F.col("x.r").alias("r"), F.col("x.size").alias("size"), F.explode("x.sigs").alias("sig"))
    found = []
    for i in range(SLICES):
        own = signatures.where(F.pmod(F.col("sig"), F.lit(SLICES)) == i)
        found.append(durable(own.join(own.groupBy("sig").agg(F.count("*").alias("cnt")).where("cnt > 1"), "sig").distinct()))
        release_shuffles(rep.sparkSession)
    return found


def linked_classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, classes, whether a row is repeated), both tables written.

    ``rows``: doc_id, h (hash of the text), n (size of the set), key (of its class of equal sets) of every row. ``classes``: key and ``head``, the
    smallest (doc_id, h) that links reach from it; for rows with a doc_id and a set. Tables are deleted when their last reader is written.

    A class is numbered by its smallest doc_id, so leaders are early documents, which the copies resemble most; classes that have
    their smallest doc_id in common are numbered by their keys.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    sketched = durable(docs.mapInArrow(_sketch(percent, k), SKETCH).withColumn("row", F.monotonically_increasing_id()))
    rows = durable(sketched.select("doc_id", "h", "n", "row", F.xxhash64("n", "hi", "lo").alias("key")))
    known = rows.where("n > 0 and doc_id is not null")
    equal = known.groupBy("key").agg(F.min(F.struct("doc_id", "h", "row")).alias("rep")).withColumn("doc_id", F.col("rep.doc_id"))
    shared_id = equal.groupBy("doc_id").agg(F.count("*").alias("several")).where("several > 1")
    classes = durable(equal.join(shared_id, "doc_id", "left").select(
        "key", F.when(F.col("several").isNull(), F.col("doc_id")).otherwise(F.col("key")).alias("cls"), "rep"))
    repeated = known.groupBy("doc_id", "h").count().where("count > 1").limit(1).count() > 0
    picked = durable(classes.select("cls", "rep.row"))  # two numbers a class: Spark sends them to the sketches while they are few
    rep = durable(sketched.select("row", "ranges").join(picked, "row").select("cls", F.explode("ranges").alias("x")))
    forget(sketched, picked)
    found = shared_signatures(rep)
    forget(rep)
    own = Window.partitionBy("cls", "size", "r")
    shared = (together(*found)
              .withColumn("n_shared", F.count("*").over(own)).where("n_shared >= r")
              .withColumn("place", F.row_number().over(own.orderBy(F.desc("cnt"), "sig"))))
    shared = durable(shared.select("cls", "sig", "r", (F.col("place") >= F.col("r")).alias("indexed")))
    forget(*found)

    first = shared.where("indexed").groupBy("sig").agg(F.min("cls").alias("leader"), F.count("*").alias("c")).where("c > 1")
    # Of the leaders with which a class shares most signatures (or half as many), the first: near copies then agree on one.
    best = (shared.where("indexed").join(first.select("sig", "leader"), "sig").groupBy("cls", "leader").agg(F.count("*").alias("c"))
            .groupBy("cls").agg(F.collect_list(F.struct("leader", "c")).alias("l"), F.max(F.when(F.col("cls") != F.col("leader"), F.col("c"))).alias("most"))
            .select("cls", F.coalesce(F.array_min(F.transform(F.filter("l", lambda x: x["c"] * 2 >= F.col("most")), lambda x: x["leader"])),
                                      "cls").alias("leader")))
    best = best_leaders = durable(best)
    for _ in range(2):  # a leader that follows another takes its group along, so a family is few groups
        upper = best.select(F.col("cls").alias("leader"), F.col("leader").alias("upper"))
        best = best.join(upper, "leader").select("cls", F.col("upper").alias("leader"))
    at = best.join(classes, "cls").select("cls", "leader", "rep.doc_id", "rep.h")
    text = docs.join(at, ["doc_id", "h"]).select(F.col("cls").alias("doc_id"), "text", "leader")
    if repeated:
        text = text.dropDuplicates(["doc_id"])
    tokens = durable(text.mapInArrow(_with_leader(k), "cls long, leader long, tokens array<long>"))
    forget(best_leaders)
    width = tokens.groupBy("leader").agg(F.count("*").alias("c"), F.sum(F.size("tokens")).alias("t"))
    salts = width.select("leader", F.ceil(F.greatest(F.col("c") / BLOCK_DOCS, F.col("t") / BLOCK_TOKENS)).cast("int").alias("salts"))
    member = durable(tokens.select("cls", "leader").join(salts, "leader").select(
        "cls", F.xxhash64("leader", F.pmod(F.hash("cls"), F.col("salts"))).alias("block"), "leader", "salts"))

    # Every block holds its group's leader, so the links to it join the blocks of one group.
    seats = (member.select("cls", "block").union(member.where("salts > 1").select("leader", "salts").distinct().select(
        F.col("leader").alias("cls"), F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1),
                                                            lambda s: F.xxhash64(F.col("leader"), s))).alias("block")))).distinct()
    inside = durable(tokens.select("cls", "tokens").join(seats, "cls").groupBy("block").applyInArrow(_open(percent, False), "a long, b long"))
    release_shuffles(docs.sparkSession)

    label = graph.components(inside)
    seat = durable(member.select("cls", "block").join(label.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "cls", "block", F.coalesce("root", "cls").alias("root")))
    whole = seat.groupBy("block").agg(F.when(F.min("root") == F.max("root"), F.min("root")).alias("only"))
    spread = shared.select("cls", "sig", "r").join(seat, "cls")
    held = durable(spread.select("sig", F.col("block").alias("other")).distinct().join(whole.withColumnRenamed("block", "other"), "other"))
    queries = durable(spread.join(held, "sig").where("block > other and (only is null or only <> root)")
                      .groupBy("cls", "other", "r").agg(F.count("*").alias("c")).where("c >= r")
                      .select("cls", F.col("other").alias("block")).distinct())
    chunks = queries.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("chunks"))
    asked = queries.join(chunks, "block").select("cls", "block", F.pmod(F.hash("cls"), F.col("chunks")).alias("chunk"), F.lit(True).alias("query"))
    opened = member.select("cls", "block").join(chunks, "block").select(
        "cls", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("query"))
    across = tokens.select("cls", "tokens").join(asked.union(opened), "cls").groupBy("block", "chunk").applyInArrow(
        _open(percent, True), "a long, b long")

    final = graph.components(inside.union(across))
    forget(shared, tokens, member, inside, queries, label, seat, held)
    rooted = durable(classes.join(final.select(F.col("node").alias("cls"), "root"), "cls", "left").select("key", "rep", F.coalesce("root", "cls").alias("root")))
    heads = durable(rooted.groupBy("root").agg(F.min(F.struct("rep.doc_id", "rep.h")).alias("head")))
    return rows, durable(rooted.join(heads, "root").select("key", "head")), repeated


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs without ASCII white space; the set is the distinct k-word shingles, or the whole
    sequence when there are fewer words. A null or wordless text has an empty set and links with nothing. Equal
    sets link. Rows with one doc_id are kept as rows, and are documents of their own if their texts differ; a null doc_id stands
    alone (component_id null). Other columns of ``docs`` are not read.
    """
    rows, classes, _ = linked_classes(docs, k, percent)
    return rows.join(classes, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_leader(k: int):
    inner = _tokens(k)
    schema = pa.schema([("cls", pa.int64()), ("leader", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            leaders, at = batch.column(batch.schema.get_field_index("leader")), 0
            for part in inner([batch]):
                yield pa.RecordBatch.from_arrays([part.column(0), leaders.slice(at, len(part)), part.column(1)], schema=schema)
                at += len(part)
    return run


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row per group of near duplicates, the one with the smallest doc_id; all columns kept, whatever their names.

    Rows with one doc_id and different texts are different documents; of rows with equal doc_id and text one stays. Rows with a
    null doc_id or an empty set stay.
    """
    rows, classes, repeated = linked_classes(docs, k, percent)
    stay = classes.select("head.doc_id", "head.h", F.lit(True).alias("one")).distinct()
    empty = rows.where("n = 0 and doc_id is not null").select("doc_id", "h", F.lit(False).alias("one")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = docs.select(whole, "doc_id", F.xxhash64("text").alias("h")).join(stay.union(empty), ["doc_id", "h"])
    if repeated:
        found = found.where("not one").unionByName(found.where("one").dropDuplicates(["doc_id", "h"]))
    return found.select("row.*").unionByName(docs.where("doc_id is null"))
