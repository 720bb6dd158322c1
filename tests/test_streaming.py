"""The stateless text chain on a file stream: same output as batch, and a
re-run on the same checkpoint adds nothing (file source + file sink)."""
import os

import pytest
from pyspark.sql import functions as F

from textlab.functions.text import clean_text
from textlab.plans import catalog
from textlab.session import scratch_path
from textlab.streaming.text_stream import run_to_completion, start_text_job, text_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_stream_rerun_is_exactly_once(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    cols = {"out": clean_text(F.col("text"))}
    for _ in range(2):
        q = start_text_job(text_stream(spark, SF, schema, glob="documents.parquet"), cols,
                           [F.col("doc_id").alias("row_id")], sink, ckpt)
        run_to_completion(q, 300)
    out = spark.read.parquet(sink)
    batch = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("row_id"),
                                                                   clean_text("text").alias("out"))
    assert out.count() == batch.count()
    assert out.exceptAll(batch).count() == 0


def test_a_table_may_be_one_file_or_a_folder_of_files(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"see http://x.y  {i}") for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, texts.select("doc_id", clean_text("text")).collect()))
    for name, rows in {"file": texts, "folder": texts, "empty": texts.limit(0)}.items():
        (tmp_path / name).mkdir()
        for table, held in {"documents": rows, "other": texts.limit(5)}.items():
            path = tmp_path / name / f"{table}.parquet"
            if name == "file":
                held.toPandas().to_parquet(path, index=False)
            else:
                held.repartition(3).write.parquet(str(path))
        got = sorted(map(tuple, catalog.q_stream_clean_text(spark, str(tmp_path / name)).collect()))
        assert got == (want if rows is texts else [])


def test_a_job_still_running_is_no_result():
    class Running:
        stopped = False

        def awaitTermination(self, timeout):
            return False

        def exception(self):
            return None

        def stop(self):
            self.stopped = True

    query = Running()
    with pytest.raises(TimeoutError):
        run_to_completion(query, 1)
    assert query.stopped
