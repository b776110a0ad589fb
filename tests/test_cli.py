"""The command line writes every table of a report set."""

import os

from servicepulse.__main__ import main
from servicepulse.session import scratch_path

from request_paths import local_dir


def test_cli_writes_tables(spark, capsys):
    src = local_dir(scratch_path(spark, "cli-in"))
    os.makedirs(src)
    with open(os.path.join(src, "t.csv"), "w") as fh:
        fh.write("SR_TYPE,CREATED_DATE,CLOSED_DATE,ZIP_CODE,SR_PRIORITY,METHOD\n"
                 "Pothole,2024-01-01 00:00:00,2024-01-01 12:00:00,33101,1,Phone\n"
                 "Tree,2024-04-01 00:00:00,,33102,3,Web\n"
                 "Pothole,2024-07-01 00:00:00,2024-07-09 00:00:00,33101,2,Email\n")
    out = local_dir(scratch_path(spark, "cli-out"))
    assert main(["--input", src, "--kind", "seasonal", "--as-of", "2024-08-01", "--out", out, "--write-format", "json"], spark=spark) == 0
    assert set(os.listdir(out)) == {"monthly_volumes", "seasonal_volumes", "top_request_types_by_season", "seasonal_performance"}
    seasons = spark.read.json(os.path.join(out, "seasonal_volumes"))
    assert seasons.count() == 4
    out2 = local_dir(scratch_path(spark, "cli-out2"))
    assert main(["--input", src, "--kind", "goals", "--as-of", "2024-08-01", "--out", out2], spark=spark) == 0
    assert spark.read.parquet(os.path.join(out2, "priority_goals")).count() == 3
