"""Structured Streaming: enrichment and running counts over a file stream."""

import os

from servicepulse import constants as K
from servicepulse.session import scratch_path

from request_paths import local_dir
from servicepulse.streaming import stream


def test_stream_enrich_and_counts(spark):
    src = local_dir(scratch_path(spark, "stream-src"))
    os.makedirs(src)
    with open(os.path.join(src, "part1.csv"), "w") as fh:
        fh.write("SR_TYPE,CREATED_DATE,CLOSED_DATE\nPothole,2024-01-01 00:00:00,2024-01-01 12:00:00\n"
                 "Pothole,2024-01-01 00:00:00,2024-01-10 00:00:00\nTree,2024-01-01 00:00:00,\n")
    s = stream.read_ticket_stream(spark, src, "SR_TYPE string, CREATED_DATE string, CLOSED_DATE string")
    enriched = stream.enrich_stream(s, as_of="2024-01-02 00:00:00")
    q = stream.start(stream.running_counts(enriched), fmt="memory", output_mode="complete",
                     available_now=True, query_name="cat_counts_test")
    q.awaitTermination(120)
    got = {r[K.CATEGORY_COL]: r["count"] for r in spark.sql("SELECT * FROM cat_counts_test").collect()}
    assert got == {"Excellent": 1, "Severely Delayed": 1, "In Progress (Within Target)": 1}
