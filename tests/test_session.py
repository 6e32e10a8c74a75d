"""Cluster shuffle sizing: applied only on clusters and only where the user set nothing."""

from types import SimpleNamespace

from parcel import session as S


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)

    def set(self, key, value):
        self[key] = value


def _fake(master: str, parallelism: int, **conf):
    return SimpleNamespace(conf=_Conf(conf),
                           sparkContext=SimpleNamespace(master=master,
                                                        defaultParallelism=parallelism))


def test_cluster_gets_initial_partitions_scaled_to_cores():
    spark = _fake("yarn", 8000)
    S._size_cluster_shuffles(spark)
    assert spark.conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "32000"
    assert spark.conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == S.ADVISORY_PARTITION_BYTES


def test_small_cluster_gets_the_floor():
    spark = _fake("spark://h:7077", 16, **{"spark.sql.adaptive.advisoryPartitionSizeInBytes":
                                           "67108864b"})
    S._size_cluster_shuffles(spark)
    assert spark.conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == str(
        S.CLUSTER_MIN_SHUFFLE_PARTITIONS)


def test_user_settings_and_local_mode_are_left_alone():
    user = _fake("yarn", 8000, **{"spark.sql.shuffle.partitions": "5000"})
    S._size_cluster_shuffles(user)
    assert "spark.sql.adaptive.coalescePartitions.initialPartitionNum" not in user.conf
    local = _fake("local[8]", 8)
    S._size_cluster_shuffles(local)
    assert dict(local.conf) == {}


def test_stages_too_long_to_be_compiled_are_not_fused(monkeypatch):
    for name in ("ensure_checkpoint_dir", "ship_package", "_size_cluster_shuffles"):
        monkeypatch.setattr(S, name, lambda spark: None)
    limit = "spark.sql.codegen.hugeMethodLimit"
    for given, want in (("65535", "8000"), (None, "8000"), ("20000", "20000")):
        spark = _fake("yarn", 8, **({limit: given} if given else {}))
        S.configure(spark)
        assert spark.conf[limit] == want
