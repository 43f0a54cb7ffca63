"""Spelling variant groups against plain Python, with awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from tideline import session
from tideline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, id long, run string"  # clashing names on purpose
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows):
    n = counted(rows)
    friends = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    best = {w: min(f, key=lambda v: (-n[v], v)) for w, f in friends.items() if f}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], len(friends[w]), form.get(w), n[form[w]] if w in form else None, root))
    return out


def corpus(seed=5):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randint(5, 9))) for _ in range(120)]
    base += [w[:i] + r.choice("abéç") + w[i + r.randint(0, 1):] for w in base for i in (0, 3, len(w))]
    base += ["aaaaaaa", "aaaaaaaa", "aaaabaaa", "ÀÉÏabcde", "àéïabcde", "straße", "strasse", "crossed×words", "Ünited", "UNITED"]
    weight = [5 ** r.randint(0, 4) for _ in base]
    texts = [" ".join(w.upper() if r.random() < .2 else w for w in r.choices(base, weight, k=400)) + r.choice(["", ".", "-x", "9"]) for _ in range(60)]
    return list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (70, None), (71, ""), (72, "12 !? \n"), (73, ("q" * 300 + " " + "q" * 299 + "z ") * 6)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 9, "y") for i, t in rows], SCHEMA)


def rows_of(df):
    assert set(df.columns) == {"word", "n", "n_near", "form", "form_n", "root"}
    got = [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [5, 6])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    want = expected(rows)
    assert max(x[2] for x in want) > 3 and len({x[5] for x in want}) < len(want) and any(x[3] not in (None, x[5]) for x in want)
    assert rows_of(spelling.variant_groups(frame(spark, rows).repartition(9))) == want


def test_pairs_come_once_in_each_direction(spark):
    words = ["abcdef", "abcdeff", "abcdefff", "bbcdef", "aabcdef", "zzzzzz"]
    known = spark.createDataFrame([(i, w, 5) for i, w in enumerate(words)], "id long, word string, n long")
    got = [(words[r["a"]], words[r["b"]]) for r in spelling.near_pairs(known).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a != b and near(a, b)}


def test_long_chains_and_very_long_words(spark):
    chain = [("a" * i + "b" * (14 - i), 5 * 6 ** min(i, 5)) for i in range(6)]
    rows = [(i, (w + " ") * n) for i, (w, n) in enumerate(chain)]
    rows += [(100 + i, ("x" * 20_000 + e + " ") * 5) for i, e in enumerate(["", "y", "xy"])]
    got = rows_of(spelling.variant_groups(frame(spark, rows)))
    assert {(len(w), k) for w, _, k, _, _, _ in got if w.startswith("x")} == {(20_000, 1), (20_001, 2), (20_002, 1)}
    assert {x for x in got if not x[0].startswith("x")} == expected(rows[:6])


def test_empty(spark):
    assert spelling.variant_groups(frame(spark, [])).count() == 0
    assert spelling.variant_groups(frame(spark, [(1, None), (None, "")])).count() == 0


def test_nothing_that_grows_with_the_vocabulary_is_broadcast(spark, monkeypatch):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling, "durable", lambda df: (plan(df), session.durable(df))[1])
    rows = corpus()
    found = spelling.variant_groups(frame(spark, rows))
    plan(found)
    assert rows_of(found) == expected(rows)
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]
