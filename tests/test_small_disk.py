"""What a job leaves on disk, and that writing less of it changes no row."""

import os
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from setgauge import session
from setgauge.operators import assemble as asm
from setgauge.operators import model
from setgauge.plans import fixtures as fx
from setgauge.plans import set_queries


def _shuffle_files(spark) -> set:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()  # of this session only
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def _size(path) -> int:
    return sum(os.path.getsize(p) for p in path.rglob("*.parquet"))


def test_shuffles_of_a_written_table_go(spark):
    before = _shuffle_files(spark)
    out = session.cut_lineage(spark.range(5000).groupBy((F.col("id") % 900).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(session.CLEAN_KEY, None) is None
    assert out.count() == 900
    session.discard(out)
    assert not Path(out.shared_path.removeprefix("file:")).exists()


def test_vectors_are_small_and_go_after_the_fits(spark):
    rows = spark.range(0, 20_000, 1, 2).select(
        F.col("id").alias("set_id"), (F.col("id") % 19 / 2.0).alias("rpe"), (F.col("id") % 3).cast("int").alias("fold"), *[((F.col("id") * (i + 3)) % 50 + 0.1).alias(f"f{i}") for i in range(10)]
    )
    names = [f"f{i}" for i in range(10)]
    made = model.vectors(rows, names)
    assert _size(Path(made.shared_path.removeprefix("file:"))) < 20_000 * 10 * 8 / 2
    session.discard(made)
    quick = [model.Booster(loss, rounds=1, depth=2, bins=8) for loss in ("squared", "absolute")]
    scope = []
    session.SCOPES.append(scope)  # every path handed out
    try:
        assert model.fit_blend(rows, "rpe", names, *quick).predict(rows).count() == 20_000
        assert len(model.fit_folds(rows, "rpe", names, *quick, folds=2)) == 2
    finally:
        session.SCOPES.pop()
    kinds = [Path(p).name.split("-")[0] for p in scope]
    assert kinds.count("vectors") == 2 and kinds.count("trees") == 6
    assert not [p for p in scope if Path(p.removeprefix("file:")).exists()]


@pytest.fixture
def tables(tmp_path):
    """Orders that come twice, without lines or without a number; lines without an order or values."""
    con = duckdb.connect()
    con.sql("CREATE TABLE orders AS SELECT CASE WHEN i % 17 = 5 THEN NULL ELSE i // 2 + (i % 5) END AS o_orderkey, i % 23 AS o_custkey FROM range(160) t(i)")
    con.sql(
        """CREATE TABLE lineitem AS SELECT CASE WHEN i % 29 = 3 THEN NULL ELSE i * 7 % 95 END AS l_orderkey, CASE WHEN i % 13 <> 2 THEN i * 31 % 977 END AS l_partkey,
  CAST(i % 9 AS INT) AS l_linenumber, CASE WHEN i % 11 <> 4 THEN CAST(i * 3 % 50 AS DOUBLE) END AS l_quantity, CASE WHEN i % 19 <> 7 THEN i % 11 / 100.0::DOUBLE END AS l_discount,
  i % 9 / 100.0::DOUBLE AS l_tax, CASE i % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN NULL ELSE 'N' END AS l_returnflag FROM range(700) t(i)"""
    )
    for name in ("orders", "lineitem"):
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    return con, str(tmp_path)


@pytest.mark.parametrize("view", ["bar_set", "face_set", "posture_set", "bar_full", "face_full", "posture_full"])
def test_sources_against_their_sql(spark, tables, view):
    con, folder = tables
    want = con.sql(fx.cte(view) + f"SELECT * FROM {view}")
    got = getattr(fx, view)(spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    by = [got.columns.index(c) for c in want.columns]

    def plain(rows, order):
        return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)

    assert plain(got.collect(), by) == plain(want.fetchall(), range(len(want.columns)))
    assert "hashpartitioning(set_id" not in got._jdf.queryExecution().toString()  # sums per order are shuffled, once


def test_parity_in_slices(spark, monkeypatch):
    """The join of the rows that differ, at once and in several slices, with keys that are missing, repeated or on one side only."""
    rows = [(None if i == 4 else f"s{i % 37}", float(i % 5), None if i % 6 == 0 else i / 4) for i in range(50)]
    want = spark.createDataFrame(rows, "set_id string, a double, b double")
    got = spark.createDataFrame([(k, a + (i % 9 == 0), b) for i, (k, a, b) in enumerate(rows[5:])], "set_id string, a double, b double")
    whole = sorted(asm.table_parity(want, got, ["a", "b"], buckets=64).collect())
    cuts, plain = [], asm.cut_lineage
    monkeypatch.setattr(asm, "ROWS_JOINED", 8, raising=False)
    monkeypatch.setattr(asm, "cut_lineage", lambda df, name, *args: cuts.append(name) or plain(df, name, *args))
    assert sorted(asm.table_parity(want, got, ["a", "b"], buckets=64).collect()) == whole
    assert cuts.count("compared") > 2


def test_sources_are_written_once(spark, tables):
    _, folder = tables
    sources = set_queries._written(spark, folder)
    assert len({id(s()) for s in sources}) == 3 and all(s(spark, folder) is s() for s in sources)
    written, direct = (sorted(map(repr, set_queries._whole(spark, folder, *some).collect())) for some in (sources, ()))
    assert written == direct
