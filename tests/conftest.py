import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from request_paths import SF001  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from servicepulse.session import local_session

    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def enriched001(spark):
    from servicepulse.operators.classify import enrich
    from servicepulse.sources.tables import AS_OF, requests_from_tables

    return enrich(requests_from_tables(spark, SF001), as_of=AS_OF)
