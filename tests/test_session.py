"""Scratch tables belong to a block and are gone when it ends."""

import os
import time

from netvigil import session
from netvigil.session import materialize, scratch, scratch_path, shared_dir


def test_scratch_is_removed(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark):
        assert materialize(spark.range(5), "five").count() == 5
        scratch_path(spark, "never-written")
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffled():
        folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
        return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(session._CLEANUP, None)
    table = session.materialize(spark.range(1000).repartition(7, "id"))
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert table.count() == 1000 and spark.conf.get(session._CLEANUP, None) == setting
