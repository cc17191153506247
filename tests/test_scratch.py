"""Tables in the shared folder leave nothing else behind."""

import os
import time

from lagline.sources.scratch import CLEANUP, stored


def shuffled(spark):
    home = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in home for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_a_written_tables_shuffle_files_are_gone(spark):
    before, setting = shuffled(spark), spark.conf.get(CLEANUP, None)
    held = stored(spark.range(5000).repartition(3, "id"), "left")
    deadline = time.time() + 20
    while shuffled(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled(spark) - before and held.count() == 5000 and spark.conf.get(CLEANUP, None) == setting
