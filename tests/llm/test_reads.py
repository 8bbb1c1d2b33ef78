"""How the stages read Parquet files."""

import pytest

from poolwright.llm import exact_dedup, quality_gam

VECTORED = "parquet.hadoop.vectored.io.enabled"


@pytest.mark.parametrize("stage", ["quality classifier", "exact dedup"])
def test_files_are_read_without_a_buffer_per_thread(spark, stage):
    spark.conf.unset(VECTORED)
    docs = spark.createDataFrame([(1, "one text"), (2, "one  text"), (3, "other")], "doc_id long, text string")
    if stage == "exact dedup":
        assert sorted(r.doc_id for r in exact_dedup.unique(docs).collect()) == [1, 3]
    else:
        labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
        assert quality_gam.rate(docs, labels).count() == 3
    files = spark._jsparkSession.sessionState().newHadoopConf()
    assert files.get(VECTORED) == "false"
