import os
import threading

import pytest

from brindle import session


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, _, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Cluster())


def test_writes_of_threads_leave_the_session_as_it_was(spark):
    scratch, before = session.Scratch(spark, "threads"), spark.conf.get(session._CLEANUP, None)
    many = [threading.Thread(target=lambda: session.Scratch(spark, "thread").save(spark.range(10))) for _ in range(4)]
    for t in many:
        t.start()
    for t in many:
        t.join()
    assert spark.conf.get(session._CLEANUP, None) == before and not session._WRITING
    table = scratch.save(spark.range(3))
    path = table._scratch_path.removeprefix("file://")
    assert os.path.isdir(path) and table.count() == 3
    scratch.drop(table)
    assert not os.path.isdir(path)


def test_clear(spark):
    table = session.Scratch(spark, "cleared").save(spark.range(3))
    session.clear(spark)
    assert not os.path.isdir(table._scratch_path.removeprefix("file://")) and not session._BASES
