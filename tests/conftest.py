import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from metroscope.session import get_spark
    s = get_spark("local[4]", app="metroscope-tests", shuffle_partitions=4,
                  extra={"spark.default.parallelism": "4"})
    yield s
    s.stop()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
