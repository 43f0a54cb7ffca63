"""Operators of the llm subpackage against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import decontaminate, jaccard, mixing, pitman_yor, planes, quality, repetition, substrings, toxicity, urls
from tideline.llm import text as T
from tideline.llm.queries import MIX, URL_RULES, tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, rate double, tokens string"  # clashing names on purpose


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(5, 160))) for _ in range(n)]
    for i in range(0, n, 6):
        words = texts[i].split(" ")
        words[rng.randrange(len(words))] = "edited"
        texts[(i + 1) % n] = " ".join(words)
        texts[(i + 2) % n] = texts[i]
    texts[5] = texts[7] = " ".join(vocabulary[:90])
    texts += ["", " \n\t ", "one", "two words", "x" * 5000, "same line\n" * 60, "The The " * 40, texts[0].upper()]
    return list(enumerate(texts)) + [(900, None), (0, texts[0]), (None, "no id " * 90)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1.0, "x") for i, t in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(90)] + [(None, 1, 1), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


def empty(docs):
    return docs.where("false")


def test_repetition_matches_brute_force(docs):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
           for r in repetition.repetition_rules(docs).collect()}
    for i, text in corpus():
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        covered = {x for j in range(len(w) - 7) if windows[tuple(w[j:j + 8])] > 1 for x in range(j, j + 8)}
        seen, repeats = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                repeats += line in seen
                seen.add(line)
        assert (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered),
                len(w) < 20 or 100 * len(covered) > 30 * len(w)) in got
    assert repetition.drop_rejected(docs).columns == docs.columns
    assert repetition.repetition_rules(empty(docs)).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_match_brute_force(docs, k, percent):
    sets = {}
    for i, text in corpus():
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if None not in (a, b) and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        break
    for _ in range(6):
        for i in root:
            root[i] = root[root[i]]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, k, percent).collect()]
    assert len(got) == len(corpus())
    assert set(got) == {(i, len(s), root[i]) for i, s in sets.items()}
    stay = jaccard.one_of_each(docs, k, percent)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.where("doc_id is not null").collect()) == sorted({r for i, r in root.items() if i is not None})
    assert jaccard.jaccard_components(empty(docs), k, percent).count() == 0


def test_one_of_each_with_clashing_names_and_shared_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a", 1), (1, "another text under the same id, long enough for a few shingles", "b", 2), (2, long + " end", "c", 3),
            (3, "short", "d", 4), (3, "short", "d", 4), (4, None, "e", 5), (4, None, "e", 5), (None, long, "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stay string, h long").withColumnRenamed("h", "cls")
    got = sorted((tuple(r) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[3], rows[5], rows[6], rows[7]], key=str)
    assert {(r["doc_id"], r["n_shingles"] > 9, r["component_id"]) for r in jaccard.jaccard_components(docs).collect()} == {
        (1, True, 1), (1, False, 1), (2, True, 1), (3, False, 3), (4, False, 4), (None, True, None)}


@pytest.mark.parametrize("percent", [30, 50, 60])
def test_low_thresholds_lose_no_link(spark, percent):
    rng = random.Random(percent)
    texts = []
    for i in range(40):
        n = rng.randint(20, 100)
        base = [f"g{i}w{j}" for j in range(n)]
        texts += [" ".join(base), " ".join(base[:rng.randint(n * percent // 100, n)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 1, percent).collect()}
    for a in range(0, len(texts), 2):
        x, y = (set(texts[a + i].split()) for i in (0, 1))
        assert got[a + 1] == (a if 100 * len(x & y) >= percent * len(x | y) else a + 1)


def test_linked_pairs_is_a_forest_of_true_links():
    rng = np.random.default_rng(0)
    base = np.arange(200)
    sets = [np.sort(rng.choice(base, 180, replace=False)) for _ in range(30)] + [np.arange(1000, 1050)]
    pairs = jaccard.linked_pairs(sets, 80)
    assert all(100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in pairs)
    assert len(pairs) < len(sets)


def test_planes_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = sorted(((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in planes.encode_table(docs, tokenizer_file("word_bpe_49k.json")).collect()))
    expected = {(i, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in corpus()}
    assert {(g[3], g[2]) for g in got} == expected and len(got) == len(corpus())
    at = 0
    for start, n, _, _ in got:
        assert start == at
        at += n
    ids = [g[3] for g in got if g[3] is not None]
    assert ids == sorted(ids)
    assert planes.encode_table(empty(docs), tokenizer_file("word_bpe_49k.json")).count() == 0
    some = np.array([0, 1, 2**32 - 1, 65536], np.uint32)
    assert (planes.decode_planes(planes.encode_planes(some), 4) == some).all()


def test_decontamination(spark):
    rng = random.Random(9)
    noise = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(i, noise(30) + ".\n" + noise(8)) for i in range(30)] + [(98, None), (99, "too short")]
    texts = [noise(300), items[3][1], noise(200) + " " + items[7][1].upper() + " " + noise(5000), items[5][1][:60], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, bench).collect()} == {(1, 3), (2, 7)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [0, 3, 4, 5]
    assert decontaminate.contaminated_pairs(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated_pairs(docs.where("false"), bench).count() == 0


def test_toxic_terms_are_met_at_every_mark_and_quotes_are_paired():
    automaton = toxicity.Automata(["idiot", "moron"])

    def found(text):
        batch = pa.RecordBatch.from_arrays([pa.array([text, "then idiot"])], names=["text"])
        row, word, term, _, quoted, n_words = toxicity.hits(next(T.blocks(batch)), automaton)
        assert (row[-1], word[-1], n_words[1]) == (1, 1, 2)
        return [("idiot", "moron")[t] for t in term[row == 0]], quoted[row == 0].tolist()

    for text in ("idiot/moron", "idiot,moron", "idiot\u00a0moron", "word...idiot moron"):
        assert found(text)[0] == ["idiot", "moron"]
    assert found("stupid-idiot")[0] == found("idiot\u00a0")[0] == found("ld idiott")[0] == ["idiot"]
    assert found('he said "fine" you idiot then "ok"') == (["idiot"], [False])
    assert found('he said "you idiot" and \u00abidiot\u00bb') == (["idiot", "idiot"], [True, True])
    assert found('5" idiot') == (["idiot"], [False]) and found("") == ([], [])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_automaton_accepts_what_is_near():
    rng = random.Random(4)
    terms = ["cat", "idiot", "disgusting", "discussing", "idiom"]
    machine = toxicity.Automaton(terms)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "i", "z"])
        word = "".join(word)
        if not word:
            continue
        points = np.array([ord(c) for c in word])
        state = int(machine.run(machine.classes[points], np.array([0]), np.array([len(word)]))[0])
        near = [distance(word, t) for t in terms if distance(word, t) <= toxicity.edits(t)]
        assert (machine.term[state] >= 0) == bool(near)
        assert not near or machine.distance[state] == min(near)


def test_classifiers_learn_and_survive(spark, labels):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        words = [f"w{rng.randint(0, 200)}" for _ in range(60)]
        toxic, good = i % 4 == 0, i % 3 > 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(["wretched", "scoundrel"])
        if not good:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
        marks.append((i, int(good), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "words only"), (1002, "a wretchd scoundrel")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for score, label in ((toxicity.score(docs, toxicity.fit(docs, marks)), 2), (quality.score(docs, quality.fit(docs, marks)), 1)):
        got = {r["doc_id"]: r["score"] for r in score.collect()}
        assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
        right = [(got[i] >= 0.5) == bool((i % 4 == 0) if label == 2 else (i % 3 > 0)) for i in range(400)]
        assert sum(right) >= 380
    bare = marks.where("false")
    assert toxicity.score(docs, toxicity.fit(docs, bare)).count() == len(rows)
    assert quality.score(docs, quality.fit(docs, bare)).count() == len(rows)


def test_sum_of_squares_identity():
    machine = quality.Machine()
    number, value = np.array([3, 50, 700]), np.array([0.5, 1.0, 2.0], np.float32)
    v = machine.factor[number] * value[:, None]
    pairs = sum(float(v[i] @ v[j]) for i in range(3) for j in range(i))
    assert math.isclose(float(machine.raw(np.array([0, 3]), number, value)[0]), pairs, abs_tol=1e-6)


def test_pitman_yor_base_and_totals(docs):
    got = pitman_yor.score(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in corpus()]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    expected = sorted((str(i), len(ws), sum(w in counts for w in ws), round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 6))
                      for i, ws in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == expected
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 for r in got)
    assert pitman_yor.score(empty(docs)).count() == 0


def test_repeats_match_brute_force(docs):
    texts = [(i, (t or "").encode()) for i, t in corpus()]
    seen = Counter(b[s:s + 400] for _, b in texts for s in range(len(b) - 399))
    expected = set()
    for i, b in texts:
        covered = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[b[s:s + 400]] > 1:
                covered[s:s + 400] = b"\x01" * 400
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(covered[j] and (j == 0 or not covered[j - 1]) for j in range(len(b)))
        expected.add((i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == len(texts) and {tuple(r) for r in got} == expected
    assert substrings.remove_repeats(empty(docs)).count() == 0


def test_urls(spark):
    rows = [(1, "https://a.example.com/en/1"), (2, "http://WWW.Example.com/en/x?y#z"), (3, "http://b.net/es/"), (4, "http://c.net"), (5, None), (6, "no scheme"),
            (7, "http://x.com?q=1"), (8, ""), (9, "ftp://h.org/a#b://c")] + [(10 + i, f"http://s{i}.net/fr/{i}") for i in range(40)] + [
            (60 + i, f"http://t{i}.com/{i}/z") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, URL_RULES).collect()}
    assert len(got) == len(rows)
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[5][:3] == ("", "", None) == got[6][:3]
    assert got[4][:3] == ("c.net", "", None) and got[7][:3] == ("x.com", "", None) and got[9][:2] == ("h.org", "/a")
    assert urls.filter_urls(pages.where("false"), URL_RULES).count() == 0


def test_mixing_meets_targets(spark):
    members = spark.createDataFrame([(float(n), [p, 1 - p]) for n, p in [(10, 0.9), (20, 0.2), (0, 0.5), (30, 0.6), (5, 1.0)]], "_tokens double, _p array<double>")
    history = mixing.fit_rates(members, [0.8, 0.2])
    rows = members.withColumn("r", mixing.rate_column(history, 0.0, 1e9)).collect()
    total = sum(r["_tokens"] for r in rows)
    assert math.isclose(sum(r["_tokens"] * r["r"] * r["_p"][0] for r in rows), 0.8 * total, rel_tol=0.01)
    assert all(r["r"] >= 0 for r in rows)


def test_mix_keeps_every_row(spark, docs, labels):
    from tideline.llm.queries import domains

    out = mixing.mix(docs, domains(labels), MIX)
    assert out.columns == docs.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r["doc_id"]] += 1
    assert all(count[i] >= 1 for i, _ in corpus())
    assert mixing.mixing_rates(empty(docs), domains(labels), MIX).count() == 0
    assert mixing.mixing_rates(docs, domains(labels).where("false"), MIX).count() == len(corpus())


def test_pitman_yor_learns_from_previous_words(spark):
    rng = random.Random(5)
    words = [f"{a}{b}xy" for a in "abcdefgh" for b in "klmno"]  # all with the same ending
    follow = {(a, b): rng.choice(words) for a in words[:12] for b in words[:12]}
    after = {w: words[:12][(i * 5 + 3) % 12] for i, w in enumerate(words[:12])}

    def held_out_perplexity(texts, parts):
        rows = pitman_yor.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)).where("held_out").collect()
        return 10 ** (-sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows))

    chains, triples = [], []
    for _ in range(200):
        w, chain = rng.choice(words[:12]), []
        for _ in range(20):
            chain.append(w)
            w = after[w]
        chains.append(" ".join(chain))
        # The third word follows from both before it; the previous word alone says little.
        pairs = [(rng.choice(words[:12]), rng.choice(words[:12])) for _ in range(10)]
        triples.append(" ".join(f"{a} {b} {follow[a, b]}" for a, b in pairs))
    assert held_out_perplexity(chains, 4) < 2
    few, many = held_out_perplexity(triples, 1), held_out_perplexity(triples, 7)
    assert few < 9 and abs(few - many) < 0.03 * few  # 12 * 12 * 1 for three words is 5.2 a word


def test_lexicon_keeps_every_telling_word(spark):
    rows = []
    for i in range(6000):  # a clean row stands for many labelled ones
        words = ["plain", "quoted" if i < 2 else "other"]
        rows.append((0, 583.0, " ".join(words)))
        rows.append((1, 1.0, " ".join(["plain", "quoted" if i < 1700 else "other", f"term{i // 10}x"])))
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "label int, weight double, text string"))
    assert "quoted" in found and "plain" not in found and "other" not in found
    assert {f"term{i}x" for i in range(600)} <= set(found)


def test_automata_find_the_nearest_term():
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(150)})
    machine = toxicity.Automata(terms)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 13))) for _ in range(1500)] + terms
    chars = np.array([ord(c) for w in words for c in w], np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    for _ in range(2):  # new words, then known ones
        term, far = machine.find(chars, bounds[:-1], bounds[1:])
        for w, t, d in zip(words, term.tolist(), far.tolist(), strict=True):
            near = min(((distance(w, x), i) for i, x in enumerate(terms) if distance(w, x) <= toxicity.edits(x)), default=(99, -1))
            assert (d, t) == near


def test_url_rates_count_all_rows_and_samples_hold_both_verdicts(spark):
    urls_ = [(i, f"http://one.com/{i}") for i in range(300)] + [(1000 + i, f"http://n{i}.net/fr/x") for i in range(30)]
    urls_ += [(2000 + i, "http://n0.net/fr/x") for i in range(500)]  # copies of one url
    pages = spark.createDataFrame([*urls_, (9000, "http://n0.net/other"), (9001, "http://n29.net/other")], "page_id long, url string")
    scores = {r["page_id"]: r["score"] for r in urls.filter_urls(pages, URL_RULES, 12).where("page_id >= 9000").collect()}
    assert len(scores) == 2 and 0 not in scores.values()
    rows = [(f"u{i}", float(i % 4 == 0), 1 + 99 * (i == 8)) for i in range(80)]
    frame = spark.createDataFrame(rows, "url string, label double, copies long")
    for sample, blocked in ((10, 5), (50, 20), (200, 20)):
        drawn = urls.picked(frame, {0.0: 60, 1.0: 20}, sample).collect()
        assert len(drawn) == len({r["url"] for r in drawn}) == min(sample, 80) and sum(r["label"] for r in drawn) == blocked
        assert all(math.isclose(r["weight"], r["copies"] * (20 / blocked if r["label"] else 60 / (len(drawn) - blocked))) for r in drawn)
    taught = spark.createDataFrame([("a", 1.0, 30), ("b", 0.0, 10)], "domain string, label double, copies long")
    assert {r["domain"]: r["r"] for r in urls.rates(taught, "domain", "r").collect()} == {"a": 40 / 50, "b": 10 / 30}


def test_seating_in_steps_is_close_to_one_by_one():
    rng = np.random.default_rng(0)
    n, mass, discount, k = 1000, 30.0, 0.8, 3000
    fast = pitman_yor.new_tables(np.full(k, n), discount, np.full(k, (mass - pitman_yor.STRENGTH) / discount), np.ones(k), T.mix(np.arange(1, k + 1, dtype=np.uint64)))
    slow = np.ones(k)
    for i in range(1, n):
        slow += rng.random(k) * (mass + i - discount * slow) < mass
    assert abs(fast.mean() / slow.mean() - 1) < 0.015 and abs(fast.std() / slow.std() - 1) < 0.1


def test_binomial_draws_by_key():
    key = T.mix(np.arange(1, 40_001, dtype=np.uint64))
    for n, p in ((8, 0.0), (8, 1.0), (8, 0.03), (8, 0.9), (40, 0.5), (100, 0.2), (1000, 0.1), (5000, 0.97)):
        x = pitman_yor.binomial(np.full(len(key), n), np.full(len(key), p), key, 70)
        sd = math.sqrt(n * p * (1 - p))
        assert x.min() >= 0 and x.max() <= n and (x == np.floor(x)).all()
        assert abs(x.mean() - n * p) <= 4 * sd / 200 + 1e-12 and abs(x.std() - sd) <= 0.03 * sd
        if sd:
            assert abs(((x - n * p) ** 3).mean() / sd**3 - (1 - 2 * p) / sd) < 0.1


def test_pitman_yor_does_not_depend_on_partitions(spark, docs):
    frequent = spark.createDataFrame([(2000 + i, "the same of the same " * 9) for i in range(60)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(frequent)
    one, eight = ({(r["doc_id"], r["base_score"] // 0.01): r["score"] for r in pitman_yor.score(rows.repartition(n)).collect()} for n in (1, 8))
    assert one.keys() == eight.keys() and all(math.isclose(one[k], eight[k], rel_tol=1e-9) for k in one)
