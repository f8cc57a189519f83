import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from check import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = local_session()
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # the tables of the tests are tiny
    return spark
