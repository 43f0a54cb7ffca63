"""What the driver holds of a plan grows with its exchanges, once more for each of them that ends; so long chains are written in steps."""

import random

from tideline import session
from tideline.llm import graph, jaccard


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_tables_of_the_near_duplicate_join_come_from_short_plans(spark, monkeypatch):
    rng = random.Random(8)
    noise = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(n)]
    base = [noise(60) for _ in range(12)]
    docs = [(10 * i + j, " ".join([*b, *noise(j)])) for i, b in enumerate(base) for j in range(3)]
    seen = []
    for module in (jaccard, graph):
        monkeypatch.setattr(module, "durable", lambda df: (seen.append(exchanges(df)), session.durable(df))[1])
    found = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80)
    assert {r["component_id"] for r in found.collect()} == {10 * i for i in range(12)}
    assert max(seen) <= 9, seen


def test_written_tables_are_read_in_one_scan(spark):
    tables = [session.durable(spark.range(lo, hi).toDF("x")) for lo, hi in ((0, 4), (4, 4), (4, 9))]
    both = session.together(*tables)
    assert sorted(r["x"] for r in both.collect()) == list(range(9)) and both.schema == tables[0].schema
    assert both._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    empty = [session.durable(spark.range(0).toDF("x").where("x > 1")) for _ in range(2)]
    assert session.together(*empty).count() == 0
    files = both.inputFiles()
    session.forget(both)
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert len(session.folders(tables[0])) == 1 and not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
