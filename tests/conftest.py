import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidepanel.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tidepanel-tests")


@pytest.fixture
def panel(spark):
    """Build (asset, date, price[, ret]) rows from plain lists, one day apart."""
    import datetime as dt

    def make(columns, start=dt.date(2000, 1, 3), name="price"):
        rows = [
            (asset, start + dt.timedelta(days=i), None if v is None else float(v))
            for asset, values in columns.items()
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, f"asset STRING, date DATE, {name} DOUBLE")

    return make
