"""Whole texts reach Python workers in small batches, whichever query of the library is asked for first."""

import pytest

from corpusloom.plans import catalog

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", ["normal_tokens", "page_boxes", "projected_spans", "diff_overlay", "body_segments"])
def test_batches_are_small(spark, sf_dir, name):
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "10000")
        catalog.QUERIES[name](spark, sf_dir)
        assert int(spark.conf.get(KEY)) <= 512
        spark.conf.set(KEY, "64")
        catalog.QUERIES[name](spark, sf_dir)
        assert spark.conf.get(KEY) == "64"
    finally:
        spark.conf.set(KEY, before)
