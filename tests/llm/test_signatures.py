import random
from collections import Counter

from tideline.llm import jaccard


def test_shared_signatures_come_slice_by_slice(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, level, 3, sorted({rng.randint(-400, 400) for _ in range(rng.randint(0, 12))})) for c in range(150) for level in (5, 8)]
    rep = spark.createDataFrame([(c, (r, size, sigs)) for c, r, size, sigs in rows], "cls long, x struct<r: int, size: int, sigs: array<long>>")
    count = Counter(s for *_, sigs in rows for s in sigs)
    released = []
    monkeypatch.setattr(jaccard, "release_shuffles", lambda session: released.append(session))
    found = [t.select("sig", "cls", "r", "size", "cnt").collect() for t in jaccard.shared_signatures(rep)]
    assert sorted(tuple(r) for t in found for r in t) == sorted((s, c, r, size, count[s]) for c, r, size, sigs in rows for s in sigs if count[s] > 1)
    sigs = [{r["sig"] for r in t} for t in found]
    assert len(set().union(*sigs)) == sum(map(len, sigs)) and max(map(len, sigs)) < sum(map(len, sigs)) / 2
    assert len(released) == len(found)
