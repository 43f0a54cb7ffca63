"""Benchmark decontamination against brute force, with few and many shards."""

import random
import re

import pytest

from tideline.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMAS = ("doc_id long, text string, shard string, copies string, h string", "item_id long, text string, copies string, shard string")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def cut(w, k):
    return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]


def brute(docs, items, percent=80):
    """(doc, item, n_item, n_shared, question share, answer share) of the best window of every pair, repeats included."""
    longest = max((len(words(t)) for _, t in items), default=0)
    out = []
    for d, text in docs:
        w = words(text)
        for item, it in items:
            own = words(it)
            k = min(5, len(own))
            if not k:
                continue
            stripped = it.rstrip(" \t\n\x0b\x0c\r")
            n_question = len(words(stripped[:max(stripped.rfind("\n"), 0)]))
            whole = cut(own, k)
            sets = [set(whole), {g for i, g in enumerate(whole) if not n_question or i < n_question},
                    {g for i, g in enumerate(whole) if not n_question or i + k > n_question}]
            found = [[len(s & set(cut(w[lo:lo + 2 * longest], k))) for s in sets] for lo in range(0, len(w), longest)]
            good = [f for f in found if 100 * f[0] >= percent * len(sets[0]) and f[1] and f[2]]
            if good:
                out.append((d, item, len(sets[0]), max(f[0] for f in good)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(4)
    noise = lambda n: " ".join(f"w{rng.randint(0, 150)}" for _ in range(n))
    items = [(i, noise(rng.randint(6, 30)) + ".\n" + noise(rng.randint(1, 8))) for i in range(60)]
    items += [(100, "four words in all"), (101, "Two words"), (102, "solo"), (103, "five words are in here"), (104, "a question\nso"),
              (105, None), (106, ""), (107, " \n "), (None, items[4][1]), items[6], items[6], (108, items[6][1]), (109, "again " * 12)]
    docs = []
    for i in range(60):
        own = items[i % 60][1].split(" ")
        own[rng.randrange(len(own))] = "edited"
        docs.append((i, noise(rng.randint(0, 90)) + " " + rng.choice([items[i % 60][1], items[i % 60][1].upper(), " ".join(own)]) + " " + noise(40)))
    docs += [(200, "so four words\tin ALL end"), (201, "two words"), (202, "two other words"), (203, "solo"), (204, "five words are here"),
             (205, "well five words are in here"), (206, "a question so"), (207, None), (208, ""), docs[6], (None, docs[6][1]),
             (209, noise(60_000) + " " + items[9][1] + " " + noise(200_000)), (210, "again " * 30), (211, f"{items[11][1]} {noise(50)} {items[11][1]}")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1 << 22, 1500])
def test_pairs_match_brute_force_whatever_the_shards(spark, shard_bytes):
    docs, items = rows()
    frames = [spark.createDataFrame([(i, t, *"xyz"[:n]) for i, t in given], schema).repartition(3)
              for given, schema, n in zip((docs, items), SCHEMAS, (3, 2), strict=True)]
    expected = brute(docs, items)
    pairs = decontaminate.contaminated_pairs(*frames, shard_bytes=shard_bytes).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in pairs), key=str) == expected
    assert {200, 201, 203, 205, 206, 209, 210} <= {d for d, *_ in expected if d} and not {202, 204, 207, 208} & {d for d, *_ in expected}
    whole = {(r["doc_id"], r["item_id"]): r["bm25"] for r in decontaminate.contaminated_pairs(*frames).collect()}
    assert all(abs(whole[r["doc_id"], r["item_id"]] - r["bm25"]) < 1e-9 for r in pairs)
    stay = decontaminate.drop_contaminated(*frames, shard_bytes=shard_bytes)
    assert stay.columns == frames[0].columns
    hit = {d for d, *_ in expected}
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == sorted((d for d, _ in docs if d not in hit), key=str)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], schema) for schema in SCHEMAS)
    some_docs, some_items = (spark.createDataFrame([(1, "one two three", *"xyz"[:n])], schema) for schema, n in zip(SCHEMAS, (3, 2), strict=True))
    blank = spark.createDataFrame([(1, " ", "x", "y"), (2, None, "x", "y")], SCHEMAS[1])
    for d, b in ((docs, items), (docs, some_items), (some_docs, items), (some_docs, blank)):
        assert decontaminate.contaminated_pairs(d, b).count() == 0
        assert decontaminate.drop_contaminated(d, b).count() == d.count()
