"""Vector codes against plain Python, with awkward rows."""

import hashlib
import math
import random

import pytest

from tideline.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code int, part int, _label int"  # clashing names on purpose


def brute(rows):
    kept = sorted(((i, [math.floor(4096 * x) for x in e], y) for i, e, y in rows
                   if e and all(x is not None and math.isfinite(x) for x in e)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    kept = [r for r in kept if len(r[1]) == 8 * width]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:16]] for p in range(8)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        of = [[(near(v, p)[1], cut(v, p)) for _, v, _ in kept] for p in range(8)]
        books = [[[sum(c) // len(c) for c in zip(*own, strict=True)] if (own := [x for j, x in of[p] if j == k]) else e
                  for k, e in enumerate(books[p])] for p in range(8)]
    out = [(i, y, [near(v, p) for p in range(8)]) for i, v, y in kept]
    by = {}
    for _, y, d in out:
        by[y] = by.get(y, 0) + sum(x for x, _ in d)
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in d), sum(x for x, _ in d), by[y], name) for i, y, d in out), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], SCHEMA)


def random_rows(n, dims, seed=4):
    r = random.Random(seed)
    return [(i * 7 % (n + 3), [round(r.gauss(0, .3), 4) for _ in range(dims)], r.choice([None, 1, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(("n", "dims"), [(300, 16), (40, 64), (9, 8)])
def test_matches_brute_force(spark, n, dims):
    rows = random_rows(n, dims)
    same = [(None, rows[0][1], None), (3, rows[1][1], 2), (3, rows[1][1], 2), (5, [1.5] * dims, 1), (5, [-1.5] * dims, 1)]
    gone = [(1, None, 1), (2, [], 1), (900, [.5] * (dims - 1) + [None], 1), (901, [float("nan")] * dims, 1),
            (902, [float("inf")] + [0.0] * (dims - 1), 2), (903, [.1] * (dims + 8), 2)]
    got = vector_codes.compressed(table(spark, rows + same + gone).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows + same + gone)


def test_more_than_a_block_and_one_partition(spark):
    rows = random_rows(9000, 8, 1)
    got = vector_codes.compressed(table(spark, rows).coalesce(1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_and_malformed(spark):
    none = vector_codes.compressed(table(spark, []))
    assert none.count() == 0 and none.columns[0] == "vec_id"
    assert vector_codes.compressed(table(spark, [(1, None, 1), (2, [], None)])).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(table(spark, [(1, [.1] * 9, 1)]))
    with pytest.raises(ValueError, match="magnitude"):
        vector_codes.compressed(table(spark, [(1, [4e4] * 8, 1)]))
