"""URL rules and lexical features against plain Python, and rates that do not contain a url's own verdict."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.llm import urls
from tideline.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def expected(url):
    host, path = parts(url)
    fits = [(len(r), r, a) for a, r in URL_RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def random_urls():
    rng = random.Random(8)
    hosts = ["example.com", "www.example.com", "WWW.EXAMPLE.com", "a.www.example.com", "xexample.com", "com", "net", "q.net", "É.net", "b.org", "", "net."]
    out = [f"{rng.choice(['http://', 'https://', '://', '', 'x://y://', '#://'])}{rng.choice(hosts)}{rng.choice(['/', '', '?', '#', '/en', '/en/', '/es/', '/fr/'])}"
           f"{rng.choice(['', 'a1', 'b/22', '?q=1&r=2', '#f', 'c' * 3000, chr(10) + 'n', '?a#b?c'])}" for _ in range(600)]
    return [*out, None, "", out[0], out[0]]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i if i % 50 else None, u, 0.5, "x") for i, u in enumerate(random_urls())],
                                 "page_id long, url string, score double, suffix string")


def test_rules_match_plain_python(pages):
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, URL_RULES).collect()), key=str)
    want = sorted(((i if i % 50 else None, *expected(u)) for i, u in enumerate(random_urls())), key=str)
    assert sorted((g[:4] for g in got), key=str) == sorted((w[:4] for w in want), key=str)
    ruled = lambda rows: sorted((r for r in rows if r[3]), key=str)
    assert ruled(got) == ruled(want) and {r[4] for r in got} == {"allow", "block"}


def test_features_match_plain_python(pages):
    shown = urls.lexical(urls.with_rules(pages, URL_RULES)).select("url", *urls.FEATURES[:-2]).collect()
    for r in shown:
        u = r["url"] or ""
        host, path = parts(u)
        n = max(len(u), 1)
        head = u.split("#", 1)[0]
        query = head.split("?", 1)[1] if "?" in head else ""
        digits = "0123456789"
        tail = path.lstrip("\0")[::-1]
        lead = next((i for i, c in enumerate(tail) if c in digits), len(tail))
        run = len(tail[lead:]) - len(tail[lead:].lstrip(digits))
        entropy = -sum(u.count(c) / n * math.log2(u.count(c) / n) for c in set(u))
        want = [len(u), len(host), host.count(".") + 1, path.count("/"), len(path), sum(c in digits for c in u) / n, entropy,
                query.count("&") + 1 if query else 0, len(query), "#" in u, run]
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(r[1:], want, strict=True)), (u, list(r[1:]), want)


def test_rates_without_the_own_fold(spark):
    rows = [(f"u{i}", f"d{i % 7}", float(i % 3 == 0), 1 + i % 4) for i in range(90)] + [("lone", "single", 1.0, 9)]
    taught = spark.createDataFrame(rows, "url string, domain string, label double, copies long")
    folds = {r["url"]: r["f"] for r in taught.select("url", urls.fold(F.col("url")).alias("f")).collect()}
    for r in urls.fold_rates(taught, "domain", "r").collect():
        own = [x for x in rows if x[1] == r["domain"]]
        for i in range(urls.FOLDS):
            others = [x for x in own if folds[x[0]] != i]
            assert math.isclose(r["rs"][i], (sum(x[2] * x[3] for x in others) + 10) / (sum(x[3] for x in others) + 20))
        if r["domain"] == "single":
            assert r["rs"][folds["lone"]] == 0.5 < r["r"]
