"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import text as T

SYMBOLS = b"#*$%&|<>"
# Largest share of a text's word characters covered by its most frequent n-gram, and by all n-grams found twice or more.
TOP_SHARE = {2: 0.30, 3: 0.28, 4: 0.26}
REPEATED_SHARE = {5: 0.45, 8: 0.40, 10: 0.40}
LINE_SHARE = 0.30
SYMBOL_SHARE = 0.10
MIN_WORDS = 20
TOP_FROM = 40  # shorter texts repeat function words by chance

COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, dup_line_share double, symbol_share double, "
           + ", ".join(f"top_{n}_share double" for n in TOP_SHARE) + ", "
           + ", ".join(f"repeated_{n}_share double" for n in REPEATED_SHARE))

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


def _covered(flags: np.ndarray, at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Words that lie in a flagged k-word window."""
    edge = np.zeros(n + 1, np.int32)
    hit = at[flags]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(block: T.Block) -> dict[str, np.ndarray]:
    """Counts and shares of each text in a block."""
    w = T.words(block)
    rows, data = block.hi - block.lo, block.data
    n = len(w.start)
    n_words = np.diff(w.first)
    point = (data & 0xC0) != 0x80
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(point, out=points[1:])
    chars = points[w.end] - points[w.start]
    word_chars = T.row_sums(chars, w.first)
    base = np.maximum(word_chars, 1)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": T.row_sums(_symbol[data], block.bounds)}

    # Lines: the break and the ends of the text bound them.
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([block.bounds[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data)).astype(np.int64)
    line_end = np.where((line_end > 0) & (data[np.maximum(line_end, 1) - 1] == 10), line_end - 1, line_end) if len(line_start) else line_end
    lo, hi = np.searchsorted(w.start, line_start), np.searchsorted(w.start, line_end)
    real = hi > lo
    line_start, line_end = line_start[real], line_end[real]
    line_row = np.searchsorted(block.bounds, line_start, "right") - 1
    key = T.with_row(T.span_hash(T.BYTE_VALUE[data], line_start, line_end), line_row)
    later = T.repeated(key)
    again = np.flatnonzero(later)
    later[again[np.unique(key[again], return_index=True)[1]]] = False
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    line_chars = points[line_end] - points[line_start]
    total = np.bincount(line_row, weights=line_chars, minlength=rows)
    out["dup_line_share"] = np.bincount(line_row[later], weights=line_chars[later], minlength=rows) / np.maximum(total, 1)

    starts = np.zeros(n + 1, np.int64)
    np.cumsum(chars, out=starts[1:])
    for k in sorted({*TOP_SHARE, *REPEATED_SHARE, 8}):
        gram, at = T.grams(w, k)
        key = T.with_row(gram, w.row[at])
        if k in TOP_SHARE:
            best = np.zeros(rows)
            found = T.repeated(key)
            _, first, count = np.unique(key[found], return_index=True, return_counts=True)
            where = at[found][first]
            np.maximum.at(best, w.row[where], (starts[where + k] - starts[where]) * count)
            out[f"top_{k}_share"] = np.minimum(1.0, best / base)
        else:
            inside = _covered(T.repeated(key), at, k, n)
            if k == 8:
                out["n_repeat_words"] = T.row_sums(inside, w.first)
            if k in REPEATED_SHARE:
                out[f"repeated_{k}_share"] = T.row_sums(np.where(inside, chars, 0), w.first) / base
    out["symbol_share"] = out["n_symbols"] / base
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > 30 * n_words)
    bad = out["base_failed"] | (out["dup_line_share"] > LINE_SHARE) | (out["symbol_share"] > SYMBOL_SHARE)
    for k, most in TOP_SHARE.items():
        bad |= (out[f"top_{k}_share"] > most) & (n_words >= TOP_FROM)
    for k, most in REPEATED_SHARE.items():
        bad |= out[f"repeated_{k}_share"] > most
    out["kept"] = ~bad
    return out


def _run(batches):
    schema = None
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for block in T.blocks(batch):
            got = {"doc_id": ids.slice(block.lo, block.hi - block.lo), **{k: pa.array(v) for k, v in measure(block).items()}}
            names = [c.strip().split(" ")[0] for c in COLUMNS.split(",")]
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            schema = schema or pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in COLUMNS.split(",")])
            yield pa.RecordBatch.from_arrays([got[c].cast(schema.field(c).type) for c in names], schema=schema)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, coverage shares and the verdict ``kept``.

    Words are runs without ASCII white space; a null or empty text has none and is not kept. Window and line equality is by
    64-bit hash within the text. Every text is measured whole; repeated rows and null doc_ids are kept as rows. One pass,
    no shuffle; memory per task is bounded by a block of 2 MB or the longest text. Other columns of ``docs`` are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_run, COLUMNS)


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are; one pass, no shuffle."""
    def run(batches):
        for batch in batches:
            keep = [measure(block)["kept"] for block in T.blocks(batch)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
