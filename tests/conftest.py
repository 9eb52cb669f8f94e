import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF01 = "/root/testdata/sf0.01"
SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import checkpoint_dir, get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
