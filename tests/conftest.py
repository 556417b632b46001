import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from featuremart.session import build_session
    warehouse = tempfile.mkdtemp(prefix="fm-warehouse-", dir="/tmp")
    s = build_session(master="local[*]", shuffle_partitions=8, extra={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(df, *order):
    """Collected rows as sorted tuples (order-insensitive compare, doubles to 6 decimals)."""
    out = [tuple(_norm(x) for x in r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
