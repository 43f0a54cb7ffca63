"""Bottom-k fingerprints against plain Python, with awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.llm import fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n int, h1 string, _key int, following string, copies int"  # clashing names on purpose


def hashes(text):
    w = WORD.findall(text)
    grams = [" ".join(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] * bool(w)
    return sorted({hashlib.md5(g.encode()).hexdigest()[:16] for g in grams})


def alike(a, b):
    union = sorted(set(a) | set(b))[:128]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def held(a, b):
    own = set(sorted(set(a) | set(b))[:128]) & set(a)
    return 1.0 if not a else len(own & set(b)) / len(own) if own else None


def expected(rows):
    distinct = {(i, t or "") for i, t in rows}
    assert len({i for i, _ in distinct}) == len(distinct)
    ring = sorted(distinct, key=lambda r: (r[0] is not None, r[0] or 0))
    after = {r: ring[(k + 1) % len(ring)][1] for k, r in enumerate(ring)}
    out = []
    for i, t in rows:
        t = t or ""
        n = len(t) // 4
        edited = t[:len(t) - n] + after[i, t][:n]
        a, b, c = (hashes(x)[:128] for x in (t, edited, after[i, t]))
        size = float(len(a)) if len(a) < 128 else 127 / (int(a[-1][:12], 16) / 2 ** 48)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b), alike(a, c), size, held(a, b)))
    return sorted(out, key=str)


def texts(seed=6):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcé日𝄞") for _ in range(r.randint(1, 6))) for _ in range(200)]
    out = [" ".join(r.choices(vocabulary, k=r.choice([1, 3, 4, 5, 6, 40, 300, 900]))) for _ in range(60)]
    out[11] = out[10]
    return [*out, "", None, " \n\t", "one", "no-break space joins words", "x" * 50_000, "same words again and again " * 300]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 1, "y", 7) for i, t in rows], SCHEMA)


def test_matches_brute_force(spark):
    rows = [(5 * i - 9, t) for i, t in enumerate(texts())] + [(None, "without an id " * 9), (1, texts()[2]), (1, texts()[2])]
    got = fingerprints.fingerprints(frame(spark, rows).repartition(7))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "kept_share"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_a_very_long_text_and_a_lone_one(spark):
    r = random.Random(8)
    long = " ".join(f"w{r.randint(0, 10 ** 9)}" for _ in range(250_000))
    rows = [(1, long), (2, "short"), (3, long[:2_000_000])]
    assert sorted((tuple(x) for x in fingerprints.fingerprints(frame(spark, rows)).collect()), key=str) == expected(rows)
    assert [tuple(x) for x in fingerprints.fingerprints(frame(spark, [(4, "alone in its table")])).collect()] == expected([(4, "alone in its table")])


def test_empty_and_ids_with_several_texts(spark):
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    got = fingerprints.fingerprints(frame(spark, [(1, "a b c d e f g h"), (1, "i j k l m n o p"), (2, None)])).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 15, 15]


def test_sketches_of_parts_merge_and_estimate(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40_000)]
    parts = [(g, " ".join(words[lo:lo + 2004])) for g, start in (("a", 0), ("b", 10_000)) for lo in range(start, start + 20_000, 2000)]
    r.shuffle(parts)
    sketches = spark.createDataFrame(parts, "g string, t string").select("g", fingerprints.sketch(F.col("t")).alias("s"))
    both = fingerprints.merged_by(sketches, ["g"], "s")
    got = {x["g"]: x["s"] for x in both.collect()}
    for g, start in (("a", 0), ("b", 10_000)):
        assert got[g] == hashes(" ".join(words[start:start + 20_004]))[:128]
    pair = both.groupBy().agg(F.max_by("s", "g").alias("b"), F.min_by("s", "g").alias("a"))
    one = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
                      fingerprints.distinct_shingles(F.col("a")).alias("n")).first()
    assert one["j"] == pytest.approx(1 / 3, abs=.12) and one["c"] == pytest.approx(1 / 2, abs=.16) and one["n"] == pytest.approx(20_000, rel=.25)


def test_no_python_in_the_plan(spark):
    plan = fingerprints.fingerprints(frame(spark, [(1, "a b"), (2, "c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
