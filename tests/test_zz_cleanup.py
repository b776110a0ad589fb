"""Runs last: the scratch tables of the session can be removed."""

import os

from servicepulse.session import clear_scratch_tables, ensure_checkpoint_dir, materialize

from request_paths import local_dir


def test_clear_scratch_tables(spark):
    t = materialize(spark.range(3), "cleanup-probe")
    assert t.count() == 3
    root = local_dir(ensure_checkpoint_dir(spark))
    assert "tables" in os.listdir(root)
    assert clear_scratch_tables(spark)
    assert "tables" not in os.listdir(root)
