import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from weftline.session import build_session  # noqa: E402

DATA = os.environ.get("WEFTLINE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "weftline-tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"


def rows(df, *order):
    """Rows as plain tuples, sorted by the given columns or by everything."""
    found = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return found if order else sorted(found, key=repr)


def same_rows(left, right):
    """Multiset equality, both directions."""
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    a, b = left.select(columns), right.select(columns)
    assert a.exceptAll(b).isEmpty(), "rows only on the left"
    assert b.exceptAll(a).isEmpty(), "rows only on the right"
