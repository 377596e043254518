import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from binroute.session import local_session  # noqa: E402
from binroute.sources import schemas  # noqa: E402
from helpers import DAY  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def attempts(spark):
    """Attempt rows from tuples (txid, processor, status, error, time[, date])."""

    def build(*rows):
        full = [row if len(row) == 6 else (*row, DAY) for row in rows]
        return spark.createDataFrame(full, schemas.TRANSACTIONS)

    return build


@pytest.fixture
def customers(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schemas.CUSTOMERS)
