"""What steps leave on disk, and how few links are worked on."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from setgauge.llm import common


def shuffle_files(spark):
    top = Path(spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())).parent
    return {x for x in top.glob("blockmgr-*/*/shuffle_*.data") if os.path.getsize(x)}


def settled(spark, before):
    """New shuffle files, once those being removed are gone; no garbage is collected meanwhile."""
    import time

    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_cut_leaves_no_shuffle_files(spark):
    rows = spark.range(20_000).select((F.col("id") % 9_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    grouped = rows.groupBy("k").agg(F.max("s").alias("s"))
    before = shuffle_files(spark)
    assert grouped.count() == 9_000
    assert shuffle_files(spark) - before  # a plain action leaves them to the garbage collection
    before = shuffle_files(spark)
    out = common.cut(grouped, "grouped")
    assert not settled(spark, before)
    assert out.count() == 9_000 and spark.conf.get(common.CLEAN_KEY, None) is None


def roots_by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def test_few_links_need_no_shuffles(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 203), (203, 205), (5, 5), (301, 300), (300, 301)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    found = {}
    for few in (common.FEW, 10):
        monkeypatch.setattr(common, "FEW", few)
        rows = common.components(df).collect()
        assert len(rows) == len({r.node for r in rows})
        found[few] = {r.node: r.root for r in rows}
    want = roots_by_hand([e for e in edges if e[0] != e[1]])
    assert found[10] == found[100_000] == want

    monkeypatch.setattr(common, "FEW", 100_000)
    together = common.gathered(common.cut(df, "few"))
    low = together.groupBy("a").agg(F.min("b").alias("m"))
    plan = together.join(low, "a")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and together.shared_path
