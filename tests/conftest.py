from __future__ import annotations

import pytest

from sievegate.session import get_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})


@pytest.fixture(scope="session")
def sf_dir():
    return SF
