"""Session helpers: cluster sizing, checkpoint folder, package shipping rule."""

import os

from supportflow import session as S


def test_cluster_settings_bounds():
    big = S.cluster_settings(100 * (1 << 40))
    assert int(big["spark.sql.shuffle.partitions"]) == 50000          # capped
    small = S.cluster_settings(1 << 30, executor_cores=16)
    assert int(small["spark.sql.shuffle.partitions"]) == 32           # two waves at least
    mid = S.cluster_settings(10 * (1 << 40), executor_cores=16)
    assert int(mid["spark.sql.shuffle.partitions"]) == 5120           # one per 2 GB
    assert big["spark.sql.adaptive.enabled"] == "true" and big["spark.ui.enabled"] == "false"


def test_checkpoint_dir_is_set(spark):
    d = S.ensure_checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() == d
    assert S.ensure_checkpoint_dir(spark) == d                          # stable


def test_workers_see_package_rule(spark, monkeypatch):
    root = os.path.dirname(os.path.dirname(os.path.abspath(S.__file__)))
    sc = spark.sparkContext
    monkeypatch.chdir(root)
    assert S._workers_see_package(sc, root)
    monkeypatch.chdir("/")
    monkeypatch.setenv("PYTHONPATH", "")
    assert not S._workers_see_package(sc, root)
    monkeypatch.setenv("PYTHONPATH", root)
    assert S._workers_see_package(sc, root)
