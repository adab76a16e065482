"""Session helpers: the shared folder comes from spark.checkpoint.dir."""

from featurestats.session import checkpoint_root, cluster_conf, path_exists, work_path


def test_checkpoint_root_reads_session_setting(spark):
    root = checkpoint_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    p = work_path(spark, "x")
    assert p.startswith(root + "/featurestats/x-") and p != work_path(spark, "x")
    assert not path_exists(spark, p)


def test_cluster_conf_sizes_partitions():
    conf = cluster_conf(shuffle_bytes=100 * 2**40)  # a 100 TB shuffle
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert conf["spark.sql.adaptive.enabled"] == "true" and conf["spark.sql.session.timeZone"] == "UTC"
    assert int(cluster_conf(1 << 30)["spark.sql.shuffle.partitions"]) == 200
