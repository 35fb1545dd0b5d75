"""The shared folder: default file system, none on a cluster, and what goes when."""

import types

import pytest

from lanewise.sources import folders


def session(spark, **changes):
    """A stand-in for a session with another configuration on the same JVM."""
    sc = spark.sparkContext
    own = {"conf": {}, "master": "yarn", "hadoop": sc._jsc.hadoopConfiguration(), "dir": None} | changes
    jsc = types.SimpleNamespace(hadoopConfiguration=lambda: own["hadoop"], sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: own["dir"] is not None, get=lambda: own["dir"])))
    context = types.SimpleNamespace(getConf=lambda: own["conf"], master=own["master"], _jvm=sc._jvm, _jsc=jsc, setCheckpointDir=lambda d: None)
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d: own["conf"].get(k, d)))


def test_a_path_without_a_scheme_is_of_the_default_file_system(spark):
    conf = spark.sparkContext._jvm.org.apache.hadoop.conf.Configuration(spark.sparkContext._jsc.hadoopConfiguration())
    conf.set("fs.defaultFS", "viewfs://cluster/")
    conf.set("fs.viewfs.mounttable.cluster.link./shared", "file:///tmp")
    assert folders.shared_root(session(spark, conf={"spark.checkpoint.dir": "/shared/x"}, hadoop=conf)) == "viewfs://cluster/shared/x"
    assert folders.shared_root(session(spark, conf={"spark.checkpoint.dir": "/shared/x/"})) == "file:/shared/x"


def test_no_folder_of_one_machine_on_a_cluster(spark):
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            folders.shared_root(session(spark, master=master))
    assert folders.shared_root(session(spark, master="local[2]")).startswith("file:/")


def test_tables_go(spark):
    work = folders.Workspace(spark, "test")
    a, b = work.keep(spark.range(3), "a"), work.keep(spark.range(2), "b")
    work.only("a")
    assert a.count() == 3
    fs, at = folders.file_system(spark, f"{work.path}/b")
    assert not fs.exists(at)
    assert b.columns == ["id"]
    assert folders.sweep(spark, 1) == 0
    work.drop()
    assert not fs.exists(folders.file_system(spark, work.path)[1])
