"""Work that used to run in one task or twice: views of one-row-group files, tracker chunks, the import plan."""

import os

import pandas as pd
from pyspark.sql import functions as F

from rosterspark.plans import catalog
from rosterspark.sources import fixtures
from rosterspark.streaming import state

from conftest import SF001


def test_view_of_a_single_file_is_written_by_many_tasks(spark, tmpdir_path):
    spark.range(1, 500).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmpdir_path}/customer.parquet")
    c = fixtures.contacts(spark, tmpdir_path)
    assert c.count() == 499
    assert len({os.path.basename(f) for f in c.inputFiles()}) >= spark.sparkContext.defaultParallelism


def test_tracker_events_are_combined_over_batches():
    def batch(i):
        return pd.DataFrame({"session_id": [1, 2], "ts": [i, i], "seq": [2 * i, 2 * i + 1], "type": ["record_processed", "batch_complete"],
                             "success": [True, None], "duration_ms": [None, 1.0], "phase": [None, None], "batch_number": [None, None]})
    out = pd.concat(state._parts_by_session(iter([batch(i) for i in range(50)])))
    assert len(out) == 2 and out["events"].tolist() == [50, 50] and len(out["ms_list"].iloc[1]) == 50


def test_import_results_validate_and_mark_once(spark):
    plan = catalog._import_results(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "dup_key" not in plan  # numbering reads the written rows
