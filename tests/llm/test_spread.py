"""The cells of sketches are summed in many small parts."""

import glob
import os
import tempfile
import time

from vectorloom.llm import common, iblt


def test_rows_are_dealt_into_more_parts_than_the_shuffle_has(spark, table, monkeypatch):
    parts, made = [], iblt.sketches

    def watched(jobs):
        parts.append(jobs.rdd.getNumPartitions())
        return made(jobs)

    monkeypatch.setattr(iblt, "sketches", watched)
    texts = [" ".join(f"w{k}{n}" for n in range(40)) for k in range(30)]
    assert iblt.fingerprinted(table(texts)).count() == 30
    assert parts[0] == iblt.RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_shuffles_of_a_step_that_is_done_are_freed(spark):
    common.prepare(spark)
    root = spark.sparkContext.getConf().get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()))

    def shuffles():
        return set(glob.glob(f"{root}/**/shuffle_*.data", recursive=True))

    before = shuffles()
    kept = common.cut_lineage(spark.range(1000).repartition(3, "id"))
    for _wait in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and kept.count() == 1000
