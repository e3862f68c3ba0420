import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from parlance.session import get_spark
    scratch = tempfile.mkdtemp(prefix="parlance-test-")
    s = get_spark("local[4]", "parlance-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="parlance-t-")


def rows(df, *cols):
    """Collect as sorted tuples (order-free comparison)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()),
                  key=lambda t: tuple((True, 0) if v is None else (False, v) for v in t))
