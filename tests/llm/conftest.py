import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from corpus_paths import SF  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from servicepulse.session import local_session

    return local_session("4", shuffle_partitions=4, extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})


@pytest.fixture(scope="session")
def documents(spark):
    """doc_id -> text of the small table."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, slot string, score string, label string, raw string, id long, `key` long, label_id long"


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows and ids, columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten"
    rows = [
        (1, base), (2, base), (2, base), (3, base + " eleven"), (4, None), (5, ""), (6, " \t\n"), (None, base), (None, None),
        (7, "word"), (8, "WORD"), (9, long), (10, long + " end"), (11, "é ü ß 漢字 😀"), (12, "x"), (12, "y"), (13, "y"),
    ]
    extra = ("en", None, 1, "s", "h", "l", "sc", "lb", "rw", 5, 6, 7)
    return spark.createDataFrame([(*r, *extra) for r in rows], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
