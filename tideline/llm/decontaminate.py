"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

A passage is a window of two segments of ``L`` words (``L``: words of the longest item), one window per segment, so any
occurrence of an item lies within one window. Retrieval is block-max WAND over blocks of items: a block is skipped when the sum of
its terms' largest impacts over a passage stays below the block's smallest threshold; only other blocks are opened and scored.
An item's threshold is its own score less the ``k`` largest impacts, ``k`` being the shingles that may be missing, so retrieval loses
nothing that verification would accept. Verification compares five-word shingles: of the whole item, of its question (all
but the last line) and of its answer (the last line). An item of under five words is one shingle, its whole sequence.

Items are dealt into shards of bounded size. Their number, mean and largest length and the number of items with each word are counted
by Spark over all items, so windows, scores and results do not depend on the number of shards.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm import text as T
from tideline.session import durable, forget

K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK_ITEMS = 4
SHARD_BYTES = 1 << 22  # of item texts; the index, whose block maxima are stored by word, is some ten times as large
PER_PASS = 4  # shards that one pass over the documents searches
CELLS = 1 << 20  # segments times blocks whose bounds are held at once
FILTER_BITS = 20

PAIRS = "doc_id long, item_id long, n_item long, n_shared long, bm25 double, question_overlap double, answer_overlap double"
_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()),
                    ("bm25", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


class Corpus(NamedTuple):
    """Counts over all items with a word: their number, mean and largest number of words."""

    items: int
    mean: float
    longest: int


class Index:
    """Inverted index of one shard of distinct (item, text), its block maxima, and the items' shingles.

    ``items`` are (item, text, copies); ``frequency`` is the number of items of the whole corpus with each word hash.
    """

    def __init__(self, items: list[tuple[int | None, str, int]], percent: int, corpus: Corpus, frequency: dict[int, int]):
        self.percent, self.longest = percent, corpus.longest
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in items], pa.string())], names=["text"])
        self.items = []
        terms, docs = [], []
        for block in T.blocks(batch):
            w = T.words(block, lower=True)
            for r in range(block.hi - block.lo):
                own = w.hash[w.first[r]:w.first[r + 1]]
                if not len(own):
                    continue
                item, text, copies = items[block.lo + r]
                text = text.rstrip(" \t\n\x0b\x0c\r")
                one = pa.RecordBatch.from_arrays([pa.array([text[:max(text.rfind("\n"), 0)]])], names=["text"])
                n_question = len(T.words(next(T.blocks(one))).hash)
                k = min(SHINGLE, len(own))
                grams, at = shingles(own, k)
                question, answer = (at < n_question, at + k > n_question) if n_question else (at >= 0, at >= 0)
                docs.append((item, copies, k, [np.unique(g) for g in (grams, grams[question], grams[answer])]))
                terms.append(own)
        self.terms, where = np.unique(np.concatenate(terms) if terms else np.zeros(0, np.uint64), return_inverse=True)
        df = np.array([frequency[t] for t in self.terms.view(np.int64).tolist()], np.float64)
        idf = np.log1p((corpus.items - df + 0.5) / (df + 0.5))
        cut = 0
        for (item, copies, k, sets), own in zip(docs, terms, strict=True):
            t, tf = np.unique(where[cut:cut + len(own)], return_counts=True)
            cut += len(own)
            impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / corpus.mean))
            missing = len(sets[0]) - -(-len(sets[0]) * percent // 100)
            least = impact.sum() - np.sort(impact)[::-1][:missing].sum()
            self.items.append((item, copies, k, t, impact, least * (1 - 1e-6), sets))
        self.items.sort(key=lambda x: -x[5])  # like thresholds share a block
        self.blocks = -(-len(self.items) // BLOCK_ITEMS)
        self.block_least = np.full(self.blocks, np.inf)
        for i, x in enumerate(self.items):
            self.block_least[i // BLOCK_ITEMS] = min(self.block_least[i // BLOCK_ITEMS], x[5])
        # Block maxima: for each term, the blocks that hold it and its largest impact there.
        t = np.concatenate([x[3] for x in self.items] or [np.zeros(0, np.int64)]).astype(np.int64)
        b = np.repeat(np.arange(len(self.items)) // BLOCK_ITEMS, [len(x[3]) for x in self.items])
        impact = np.concatenate([x[4] for x in self.items] or [np.zeros(0)])
        order = np.lexsort((b, t))
        t, b, impact = t[order], b[order], impact[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (b[1:] != b[:-1])])) if len(t) else np.zeros(0, np.int64)
        self.in_block = b[first].astype(np.int32)
        self.most = np.maximum.reduceat(impact, first) * (1 + 1e-6) if len(first) else impact
        self.postings = np.searchsorted(t[first], np.arange(len(self.terms) + 1))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.terms >> np.uint64(64 - FILTER_BITS)] = True

    def term_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of indexed words and their term numbers."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - FILTER_BITS)])
        number = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        ok = self.terms[number] == hashes[at]
        return at[ok], number[ok]

    def bounds(self, segment: np.ndarray, term: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Sum of the block maxima of the distinct terms of each segment lo..hi, by segment and block; ``segment`` ascends."""
        a, z = np.searchsorted(segment, (lo, hi))
        pair = np.unique((segment[a:z] - lo) * len(self.terms) + term[a:z])
        seg, t = pair // len(self.terms), pair % len(self.terms)
        n = self.postings[t + 1] - self.postings[t]
        at = np.repeat(self.postings[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        cell = np.repeat(seg * self.blocks, n) + self.in_block[at]
        return np.bincount(cell, self.most[at], (hi - lo) * self.blocks).reshape(hi - lo, self.blocks)

    def opened(self, segment: np.ndarray, term: np.ndarray, follows: np.ndarray) -> list[tuple[int, int]]:
        """(window, block) whose bound reaches the block's smallest threshold; window i holds segment i and the next of its text."""
        out: list[tuple[int, int]] = []
        step = max(1, CELLS // self.blocks)
        for lo in range(0, len(follows), step):
            hi = min(lo + step, len(follows))
            sums = self.bounds(segment, term, lo, hi + 1)  # the segment after the last one is empty
            bound = sums[:-1] + sums[1:] * follows[lo:hi, None]
            window, block = np.nonzero(bound >= self.block_least * (1 - 1e-6))
            out += zip((window + lo).tolist(), block.tolist(), strict=True)
        return out

    def search(self, w: T.Words) -> list[tuple]:
        """(row, item, n_item, n_shared, score, question share, answer share) of every verified pair, best window each."""
        if not self.items or not len(w.hash):
            return []
        at, term = self.term_of(w.hash)
        if not len(at):
            return []
        seg_count = -(-np.diff(w.first) // self.longest)
        seg_first = np.concatenate([[0], np.cumsum(seg_count)])
        seg_at = (seg_first[w.row] + (np.arange(len(w.row)) - w.first[w.row]) // self.longest)[at]
        seg_row = np.repeat(np.arange(len(seg_count)), seg_count)
        follows = np.append(seg_row[1:] == seg_row[:-1], False)
        edges = np.searchsorted(seg_at, np.arange(len(seg_row) + 2))
        present = np.zeros(len(self.terms))
        best: dict[tuple[int, int], tuple] = {}
        last, cache = -1, {}
        for win, blk in self.opened(seg_at, term, follows):
            if win != last:
                present[:] = 0.0
                present[term[edges[win]:edges[win + 1 + bool(follows[win])]]] = 1.0
                last, cache = win, {}
            for i in range(blk * BLOCK_ITEMS, min((blk + 1) * BLOCK_ITEMS, len(self.items))):
                _, _, k, t, impact, least, sets = self.items[i]
                score = float(impact @ present[t])
                if score < least:
                    continue
                if k not in cache:
                    row = seg_row[win]
                    lo = w.first[row] + (win - seg_first[row]) * self.longest
                    cache[k] = shingles(w.hash[lo:min(w.first[row + 1], lo + 2 * self.longest)], k)[0]
                shared = [int(np.isin(s, cache[k]).sum()) for s in sets]
                if 100 * shared[0] < self.percent * len(sets[0]) or not shared[1] or not shared[2]:
                    continue
                key = (int(seg_row[win]), i)
                found = (shared[0], score, shared[1] / len(sets[1]), shared[2] / len(sets[2]))
                if key not in best or found > best[key]:
                    best[key] = found
        return [(row, self.items[i][0], len(self.items[i][6][0]), *found) for (row, i), found in sorted(best.items())
                for _ in range(self.items[i][1])]


def shingles(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of one sequence of word hashes, and where they start."""
    return T.grams(T.Words(None, None, np.zeros(len(hashes), np.int64), hashes, None), k)


def _item_words(batches):
    """(shard, n, h): the distinct word hashes h of each item; one row with a null h and the item's number of words n."""
    schema = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
        for block in T.blocks(batch):
            w = T.words(block, lower=True)
            own = shard[block.lo:block.hi]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.diff(w.first)), pa.nulls(len(own), pa.int64())], schema=schema)
            order = np.lexsort((w.hash, w.row))
            row, h = w.row[order], w.hash[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[row[new]]), pa.nulls(int(new.sum()), pa.int64()), pa.array(h[new].view(np.int64))], schema=schema)


def indexes(benchmark: DataFrame, percent: int = 80, shard_bytes: int = SHARD_BYTES):
    """Indexes of bounded size, one at a time: distinct (item_id, text) are dealt into shards by hash when their texts exceed ``shard_bytes``.

    The driver holds one shard and its words' counts at a time.
    """
    items = benchmark.where("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // shard_bytes)
    if not shards:
        return
    items = durable(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("long")))
    words = durable(items.select("shard", "text").mapInArrow(_item_words, "shard long, n long, h long"))
    found = words.where("n > 0").agg(F.count("*"), F.avg("n"), F.max("n")).first()
    if found[0]:
        known = words.where("h is not null")
        frequency = durable(known.groupBy("h").agg(F.count("*").alias("df")))
        counted = durable(known.select("shard", "h").distinct().join(frequency, "h"))
        for shard in range(shards):
            own = [tuple(r) for r in items.where(F.col("shard") == shard).select("item_id", "text", "copies").collect()]
            yield Index(own, percent, Corpus(*found), {r["h"]: r["df"] for r in counted.where(F.col("shard") == shard).select("h", "df").collect()})
        forget(frequency, counted)
    forget(items, words)


def passes(benchmark: DataFrame, percent: int, shard_bytes: int):
    """Broadcast indexes, as many at a time as one pass over the documents searches."""
    context, some = benchmark.sparkSession.sparkContext, []
    for index in indexes(benchmark, percent, shard_bytes):
        some.append(context.broadcast(index))
        if len(some) == PER_PASS:
            yield some
            some = []
    if some:
        yield some


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, percent: int = 80, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, bm25, question_overlap, answer_overlap): every document window that holds
    ``percent`` % of an item's distinct five-word shingles, something of its question and of its answer; best window each.

    Words are lower-cased (A-Z) runs without ASCII white space. An item of under five words must be held as a whole. Null texts and those
    without a word match nothing. Repeated rows on either side give repeated pairs. Among windows, more shared shingles, then a larger
    bm25, question share and answer share win; equal ones give one row. Texts of any length are searched whole, a block of texts or one
    long text at a time. Other columns are not read. No shuffle of documents.
    """
    spark = docs.sparkSession
    out = None
    for shards in passes(benchmark, percent, shard_bytes):
        def run(batches, shards=shards):
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                for block in T.blocks(batch):
                    w = T.words(block, lower=True)
                    rows = [(ids[block.lo + r], *rest) for one in shards for r, *rest in one.value.search(w)]
                    yield pa.RecordBatch.from_pylist([dict(zip(_PAIRS.names, row, strict=True)) for row in rows], schema=_PAIRS)

        part = docs.select("doc_id", "text").mapInArrow(run, PAIRS)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], PAIRS) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` without a contaminated pair, all columns kept; no shuffle."""
    for shards in passes(benchmark, percent, shard_bytes):
        def run(batches, shards=shards):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for block in T.blocks(batch):
                    w = T.words(block, lower=True)
                    for one in shards:
                        keep[[block.lo + r for r, *_ in one.value.search(w)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
