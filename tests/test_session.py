from types import SimpleNamespace

import pytest

from curbside import session


def fake(conf, master):
    values = dict(conf)
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: values.get(key, default), set=values.__setitem__),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
    )


def test_the_folder_of_the_cluster_is_used():
    assert session.shared_dir(fake({"spark.checkpoint.dir": "hdfs:///x"}, "yarn")) == "hdfs:///x"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.shared_dir(fake({}, "spark://host:7077"))


def test_a_local_session_gets_one_folder():
    spark = fake({}, "local[4]")
    assert session.shared_dir(spark) == session.shared_dir(spark)


def test_stage_keeps_rows_and_types(spark):
    df = spark.sql("select 1 as a, cast(null as double) as b, array(struct(1.5d as x)) as c")
    table = session.stage(df, "probe")
    assert table.collect() == df.collect() and table.dtypes == df.dtypes
    assert session.stage(df.where("a > 1"), "empty").collect() == []
