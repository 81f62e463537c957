"""What the steps of a query leave on disk."""

import os
import time

from pyspark.sql import functions as F

from corpusloom.session import cut_lineage, write_step


def _shuffle_files(spark):
    return sum(x.startswith("shuffle_") for _, _, names in os.walk(spark.conf.get("spark.local.dir")) for x in names)


def test_steps_leave_no_shuffle_files(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(50_000).groupBy((F.col("id") % 999).alias("k")).count()
    rows.collect()  # an ordinary query leaves its files to the collector of garbage
    before, setting = _shuffle_files(spark), spark.conf.get(name)
    out, written = cut_lineage(rows), write_step(rows, str(tmp_path / "rows"))
    for _ in range(100):  # files are removed in the background
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert before and _shuffle_files(spark) <= before
    assert spark.conf.get(name) == setting
    for df in (out, written):
        assert (df.count(), df.agg(F.sum("count")).first()[0]) == (999, 50_000)
