"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the hits' context windows.

The lexicon is learned from labelled training documents (words that mark the toxic ones). The automata of all words within an
edit bound of any term are deterministic tables of some terms each, stepped over all words of a block at once in numpy. Hits are weighed by
how well (term, distance) separates the classes in the sample, and split by context: words near quotation marks count as
quotation, others as abuse. A logistic fit over these sums gives the score.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm import sampling, text as T

PER_CLASS = 6000
MIN_DOCS = 4
RATIO = 4.0
CHANCE = 0.01
AROUND = 4
CHUNK = 32
MEMORY = 1 << 20
WINDOW = 12
QUOTES = "\"“”„«»‹›"
N_FEATURES = 6

_chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(1 << 16)]
_LOWER = np.array([ord(c.lower()[0]) for c in _chars], np.uint32)
_WORDY = np.array([unicodedata.category(c)[0] in "LNM" for c in _chars])
_SPACE = np.zeros(1 << 16, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_QUOTE = np.zeros(1 << 16, bool)
_QUOTE[[ord(c) for c in QUOTES]] = True


def edits(term: str) -> int:
    """Edit bound of a term: short ones must match exactly."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """Deterministic automaton of all words within ``edits(term)`` of a term; says the term and the distance."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        reach: list[int] = [0]
        for number, term in enumerate(terms):
            node = 0
            reach[0] = max(reach[0], edits(term))
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                    reach.append(0)
                node = children[node][c]
                reach[node] = max(reach[node], edits(term))
            ends[node] = number
        alphabet = sorted({c for t in terms for c in t})
        self.classes = np.zeros(1 << 16, np.int16)
        for i, c in enumerate(alphabet):
            if ord(c) < 1 << 16:
                self.classes[ord(c)] = i + 1

        def close(state: dict[int, int]) -> tuple:
            todo = list(state.items())
            while todo:
                node, e = todo.pop()
                for child in children[node].values():  # the word lacks a character of the term
                    if e + 1 <= reach[child] and state.get(child, 99) > e + 1:
                        state[child] = e + 1
                        todo.append((child, e + 1))
            return tuple(sorted(state.items()))

        first = close({0: 0})
        number = {(): 0, first: 1}
        rows, queue = [[0] * (len(alphabet) + 1)], [first]
        while queue:
            state, row = queue.pop(0), []
            expected = {c for node, _ in state for c in children[node]}
            for c in [None, *alphabet]:
                if row and c not in expected:  # as good as a character of no term
                    row.append(row[0])
                    continue
                after: dict[int, int] = {}
                for node, e in state:
                    if e + 1 <= reach[node]:
                        after[node] = min(after.get(node, 99), e + 1)  # an extra character
                    for letter, child in children[node].items():
                        cost = e + (letter != c)
                        if cost <= reach[child]:
                            after[child] = min(after.get(child, 99), cost)
                key = close(after)
                if key not in number:
                    number[key] = len(number)
                    queue.append(key)
                row.append(number[key])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.term = np.full(len(number), -1, np.int32)
        self.distance = np.zeros(len(number), np.int32)
        for state, i in number.items():
            found = [(e, ends[node]) for node, e in state if ends[node] >= 0 and e <= edits(terms[ends[node]])]
            if found:
                self.distance[i], self.term[i] = min(found)

    def run(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """State after each word (0: dead)."""
        state = np.zeros(len(start), np.int32)
        live, now, at = np.arange(len(start)), np.ones(len(start), np.int32), start.copy()
        while len(live):
            done = at[live] >= end[live]
            state[live[done]] = now[done]
            live, now = live[~done], now[~done]
            now = self.table[now, classes[at[live]]]
            at[live] += 1
            keep = now > 0
            live, now = live[keep], now[keep]
        return state


class Automata:
    """Automata of ``CHUNK`` terms of like length each, so that tables grow as the lexicon does and a word runs through those near its length."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        order = sorted(range(len(terms)), key=lambda k: (edits(terms[k]), len(terms[k]), terms[k]))
        chunks = [sorted(order[i:i + CHUNK]) for i in range(0, len(terms), CHUNK)]
        self.parts = [(np.array(chunk, np.int32), Automaton([terms[k] for k in chunk])) for chunk in chunks]
        self.reach = [(min(len(t) - edits(t) for t in part.terms), max(len(t) + edits(t) for t in part.terms)) for _, part in self.parts]
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def nearest(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, near = np.full(len(start), len(self.terms), np.int32), np.full(len(start), 99, np.int32)
        size = end - start
        for (number, part), (least, most) in zip(self.parts, self.reach, strict=True):
            at = np.flatnonzero((size >= least) & (size <= most))
            state = part.run(part.classes[chars], start[at], end[at])
            ok = part.term[state] >= 0
            at, t, d = at[ok], number[part.term[state[ok]]], part.distance[state[ok]]
            better = (d < near[at]) | ((d == near[at]) & (t < best[at]))
            best[at[better]], near[at[better]] = t[better], d[better]
        return np.where(near < 99, best, -1), near

    def find(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest term of each word (-1: none; the first of equally near ones) and its distance. Words met before are looked up."""
        word, one, of = np.unique(T.span_hash(T.mix(chars.astype(np.uint64) + np.uint64(1)), start, end), return_index=True, return_inverse=True)
        known = self.known
        at = np.minimum(np.searchsorted(known[0], word), max(len(known[0]) - 1, 0))
        old = known[0][at] == word if len(known[0]) else np.zeros(len(word), bool)
        term, distance = np.full(len(word), -1, np.int32), np.full(len(word), 99, np.int32)
        term[old], distance[old] = known[1][at[old]], known[2][at[old]]
        new = ~old
        term[new], distance[new] = self.nearest(chars, start[one[new]], end[one[new]])
        if len(known[0]) > MEMORY:
            known = tuple(x[:0] for x in known)
        both = [np.concatenate([x, y]) for x, y in zip(known, (word[new], term[new], distance[new]), strict=True)]
        order = np.argsort(both[0], kind="stable")
        self.known = tuple(x[order] for x in both)
        return term[of], distance[of]


def code_points(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters (beyond the basic plane: 0xFFFF) of a block, and the bounds of its texts."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    return _LOWER[np.minimum(points, 0xFFFF)], lead[block.bounds]


def hits(block: T.Block, automaton: Automata) -> tuple[np.ndarray, ...]:
    """Row, word number, term, distance and quoted flag of each hit; and the words of each row."""
    chars, bounds = code_points(block)
    wordy = _WORDY[chars]
    inside = ~_SPACE[chars]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(chars)]
    opens[edge] = inside[edge]
    word_start = np.flatnonzero(opens)
    first = np.searchsorted(word_start, bounds)
    # Candidates: every run of letters, digits and accents, as the lexicon has them; and of a word with several, all from the first to the last.
    letters = np.flatnonzero(wordy)
    head = np.ones(len(letters), bool)
    head[1:] = (np.diff(letters) > 1) | np.isin(letters[1:], edge)
    start, end = letters[head], letters[np.append(np.flatnonzero(head)[1:] - 1, len(letters) - 1)] + 1 if len(letters) else letters
    word = np.searchsorted(word_start, start, "right") - 1
    several = np.flatnonzero(np.bincount(word, minlength=len(word_start)) > 1)
    low, high = np.searchsorted(word, several), np.searchsorted(word, several, "right") - 1
    word, start, end = np.append(word, several), np.append(start, start[low]), np.append(end, end[high])
    order = np.lexsort((start, word))
    word, start, end = word[order], start[order], end[order]
    term, distance = automaton.find(chars, start, end)
    found = np.flatnonzero(term >= 0)
    word, start, term, distance = word[found], start[found], term[found], distance[found]
    row = np.searchsorted(first, word, "right") - 1
    # Quoted: an odd number of marks stands before it in its text, and the marks on both sides are near.
    marks = np.flatnonzero(_QUOTE[chars])
    at = np.append(np.searchsorted(word_start, marks, "right") - 1, -1)
    of_row = np.searchsorted(marks, bounds)
    before = np.searchsorted(marks, start)
    odd = ((before - of_row[row]) % 2 == 1) & (before < of_row[row + 1])
    quoted = odd & (word - at[np.maximum(before - 1, 0)] <= WINDOW) & (at[np.minimum(before, len(marks))] - word <= WINDOW)
    return row, word - first[row], term, distance, quoted, np.diff(first)


def features(found: tuple[np.ndarray, ...], weights: np.ndarray) -> np.ndarray:
    """Per row: abuse and quotation sums, the largest weight, hits per 100 words, largest sum in a window, any hit."""
    row, word, term, distance, quoted, n_words = found
    out = np.zeros((len(n_words), N_FEATURES))
    w = weights[term, np.minimum(distance, 2)]
    np.add.at(out[:, 0], row, np.where(quoted, 0, w))
    np.add.at(out[:, 1], row, np.where(quoted, w, 0))
    np.maximum.at(out[:, 2], row, np.where(quoted, 0.5, 1.0) * w)
    np.add.at(out[:, 3], row, 100.0 * (w > 0) / np.maximum(n_words[row], 1))
    if len(row):
        total = np.concatenate([[0], np.cumsum(np.where(quoted, 0, w))])
        place = row.astype(np.int64) * (1 << 40) + word
        till = np.searchsorted(place, place + WINDOW, "right")
        np.maximum.at(out[:, 4], row, total[till] - total[np.arange(len(row))])
    np.maximum.at(out[:, 5], row, (w > 0).astype(float))
    return np.log1p(out)


class Model:
    def __init__(self, automaton: Automata, weights: np.ndarray, linear: np.ndarray):
        self.automaton, self.weights, self.linear = automaton, weights, linear

    def scores(self, block: T.Block) -> tuple[np.ndarray, np.ndarray]:
        x = features(hits(block, self.automaton), self.weights)
        z = x @ self.linear[:-1] + self.linear[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), x


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Words that mark the toxic documents of the sample beyond chance, the most telling first.

    A word counts in a document, but copies of one passage count once: its number is that of documents or that of different surroundings
    (``AROUND`` words on each side), whichever is less. Its smoothed share of the toxic documents is over ``RATIO`` times that of the clean ones,
    and larger in both halves of the sample (dealt by hash of the id); and the likelihood ratio of two shares against one exceeds what
    the best of all words tried reaches by chance with a probability of ``CHANCE`` at most.
    """
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half")
    rows = {(r["label"], r["half"]): r["count"] for r in sample.groupBy("label", half).count().collect()}
    split = sample.select("label", half, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)).alias("ws"))
    sides = [k for k in range(-AROUND, AROUND + 1) if k]
    around = lambda i: F.xxhash64(*[F.coalesce(F.when(i + k >= 0, F.get(F.col("ws"), F.greatest(i + k, F.lit(0)))), F.lit("")) for k in sides])
    words = split.select("label", "half", "doc_id", F.explode(F.transform("ws", lambda w, i: F.struct(w.alias("w"), around(i).alias("c")))).alias("x")) \
        .select("label", "half", "doc_id", "x.w", "x.c").where("length(w) between 3 and 40")
    found = words.groupBy("w", "label", "half").agg(F.least(F.count_distinct("doc_id"), F.count_distinct("c")).alias("n"))
    counts = found.groupBy("w").agg(*[F.coalesce(F.sum(F.when((F.col("label") == k) & (F.col("half") == h), F.col("n"))), F.lit(0)).alias(f"n{k}{h}")
                                      for k in (0, 1) for h in (0, 1)]).where(f"n10 + n11 >= {MIN_DOCS}")
    tried = counts.count()
    if not tried:
        return []
    total = [sum(rows.get((k, h), 0) for h in (0, 1)) for k in (0, 1)]
    share = lambda n, size: (n + 0.5) / (size + 1.0)
    ratio = lambda h: share(F.col(f"n1{h}"), rows.get((1, h), 0)) / share(F.col(f"n0{h}"), rows.get((0, h), 0))
    toxic, clean = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    both = (toxic + clean) / float(sum(total))

    def gain(n, size, p):  # log likelihood of n of size at its own share over that at p
        own = n / float(max(size, 1))
        return F.when(n > 0, n * F.log(own / p)).otherwise(0.0) + F.when(n < size, (size - n) * F.log((1 - own) / (1 - p))).otherwise(0.0)

    bound = math.log(tried / CHANCE)  # a likelihood ratio of one degree of freedom exceeds 2 b with a chance below exp(-b)
    whole = share(toxic, total[1]) / share(clean, total[0])
    good = counts.where((whole > RATIO) & (ratio(0) > 1) & (ratio(1) > 1) & (both < 1)).where(gain(toxic, total[1], both) + gain(clean, total[0], both) > bound)
    return [r["w"] for r in good.orderBy(F.desc(whole), "w").select("w").collect()]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, lexicon: list[str] | None = None) -> Model:
    """Learn lexicon, hit weights and the score from at most ``2 * per_class`` labelled rows outside the held-out fold."""
    sample = sampling.labelled_sample(docs, labels, "toxic", 4, 2, per_class)
    automaton = Automata(sorted(learn_lexicon(sample) if lexicon is None else lexicon))

    def run(batches):
        for batch in batches:
            label, weight = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("label", "weight"))
            for block in T.blocks(batch):
                row, word, term, distance, quoted, n_words = hits(block, automaton)
                cuts = np.searchsorted(row, np.arange(len(n_words) + 1))
                yield pa.RecordBatch.from_pylist([
                    {"label": int(label[block.lo + r]), "weight": float(weight[block.lo + r]), "n": int(n_words[r]),
                     "word": word[x:y].tolist(), "term": term[x:y].tolist(), "distance": distance[x:y].tolist(), "quoted": quoted[x:y].tolist()}
                    for r, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))], schema=schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema([("label", pa.int32()), ("weight", pa.float64()), ("n", pa.int64()), ("word", ints), ("term", ints),
                        ("distance", ints), ("quoted", pa.list_(pa.bool_()))])
    rows = sample.mapInArrow(run, "label int, weight double, n long, word array<int>, term array<int>, distance array<int>, quoted array<boolean>").collect()
    y = np.array([r["label"] for r in rows], float)
    weight = np.array([r["weight"] for r in rows], float)
    seen = np.zeros((2, max(len(automaton.terms), 1), 3))
    for r in rows:
        for t, d in set(zip(r["term"], r["distance"], strict=True)):
            seen[r["label"], t, min(d, 2)] += r["weight"]
    totals = np.array([weight[y == 0].sum(), weight[y == 1].sum()]) + 1
    odds = np.log((seen[1] + 0.05) / totals[1]) - np.log((seen[0] + 0.05) / totals[0])
    weights = np.where((seen.sum(0) > 0) & (odds > 0.7), np.minimum(odds, 5.0), 0.0)
    # Distances that the sample does not show weigh like weaker evidence of the same term.
    for d in (1, 2):
        weights[:, d] = np.where(seen[:, :, d].sum(0) > 0, weights[:, d], weights[:, d - 1] * 0.6)
    if rows:
        size = [len(r["word"]) for r in rows]
        found = (np.repeat(np.arange(len(rows)), size), *(np.array([x for r in rows for x in r[c]], np.int64) for c in ("word", "term", "distance")),
                 np.array([x for r in rows for x in r["quoted"]], bool), np.array([r["n"] for r in rows]))
        x = features(found, weights)
    else:
        x = np.zeros((0, N_FEATURES))
    # Classes count alike, so that 0.5 is where the evidence is even.
    balance = weight * np.where(y == 1, 1 / totals[1], 1 / totals[0])
    return Model(automaton, weights, sampling.fit_logistic(x, y, balance) if math.isfinite(balance.sum()) else np.zeros(N_FEATURES + 1))


SCORES = "doc_id long, score double, n_hits double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and log hit density of each row of ``docs``; null and empty texts get the score of no hits.

    One pass over whole texts, no shuffle. Repeated rows are scored each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.float64())])

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for block in T.blocks(batch):
                p, x = shared.value.scores(block)
                yield pa.RecordBatch.from_arrays([ids.slice(block.lo, block.hi - block.lo), pa.array(p), pa.array(x[:, 3])], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)
