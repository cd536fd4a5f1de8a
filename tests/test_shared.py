import pytest

from corvine.sources import shared


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        shared.shared_root(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared.shared_root(Session())
    Context.master = "local[2]"
    assert shared.shared_root(Session()).startswith("file:///")
    assert shared.shared_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")


def test_made_folders_are_removed(spark, monkeypatch):
    monkeypatch.setattr(shared, "_made", [])
    folder = shared.shared_dir(spark)
    spark.range(3).write.parquet(f"{folder}/t")
    assert shared.remove_made(spark) == 1 and shared.remove_made(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(f"{folder}/t")


def test_a_missing_index_is_built_again(spark):
    from corvine.plans import registry

    sf = "/root/testdata/sf0.001"
    n = registry.trigram_search(spark, sf).count()
    built = dict(registry._indexes)
    shared.remove_made(spark)
    assert registry.trigram_search(spark, sf).count() == n and registry._indexes != built
