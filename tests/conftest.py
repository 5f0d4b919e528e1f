import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marketflow.session import get_session
    s = get_session("local[*]", 8)
    yield s


def rows(df, order=None):
    d = df.orderBy(*order) if order else df
    return [tuple(r) for r in d.collect()]
