import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "scripts"))

from wavespan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    def make(schema, rows):
        return spark.createDataFrame(rows, schema)
    return make


def values(df, *columns, order=("pid", "year")):
    """Rows as tuples in a stable order."""
    keys = [c for c in order if c in df.columns]
    rows = df.orderBy(*keys).select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]
