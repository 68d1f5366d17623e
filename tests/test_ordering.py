"""Ordering helpers: exact global positions, reliable materialisation."""

from pyspark.sql import functions as F

from corvid.plans.ordering import blocked_running_sum, materialize, with_global_position


def test_global_position_is_exact_and_dense(spark):
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 2000).alias("k")).repartition(7)
    pos = with_global_position(df, [F.col("k")], "p")
    rows = sorted((r.p, r.k) for r in pos.collect())
    assert [p for p, _ in rows] == list(range(2000))
    assert [k for _, k in rows] == list(range(2000))


def test_blocked_running_sum_without_key(spark):
    df = spark.range(0, 300).select(F.col("id").alias("o"), (F.col("id") % 2).alias("v"))
    out = blocked_running_sum(df, [], "o", F.col("v"), "s", block_size=7)
    got = {r.o: r.s for r in out.collect()}
    assert all(got[o] == (o + 1) // 2 for o in range(300))


def test_materialize(spark):
    one = spark.range(0, 100).coalesce(1)
    m = materialize(one.withColumn("x", F.col("id") * 2))
    assert m.agg(F.sum("x")).first()[0] == 9900
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        m.explain()
    assert "ExistingRDD" in buf.getvalue()      # lineage cut: reads the checkpoint


def test_checkpoint_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from corvid.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="yarn")
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
