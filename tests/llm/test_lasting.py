from types import SimpleNamespace

import pytest

from ledgerlake.errors import InvalidArgument
from ledgerlake.llm.lasting import CHECKPOINTS, shared_folder


def session(master, **named):
    """A session without a checkpoint folder, which notes the one it is given."""
    given = []
    scala = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: scala), getConf=lambda: named, setCheckpointDir=given.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default)), given


def test_clusters_must_name_a_shared_folder():
    cluster, given = session("spark://host:7077")
    with pytest.raises(InvalidArgument):
        shared_folder(cluster)
    assert not given
    for master, named in (("spark://host:7077", {CHECKPOINTS: "hdfs:///c"}), ("local[4]", {CHECKPOINTS: "hdfs:///c"})):
        spark, given = session(master, **named)
        shared_folder(spark)
        assert given == ["hdfs:///c"]
    local, given = session("local[4]")
    shared_folder(local)
    assert len(given) == 1 and "checkpoints-" in given[0]
