from __future__ import annotations

import pytest

from tests.compare import duck, session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    found = session()
    yield found
    found.stop()


@pytest.fixture(scope="session")
def con():
    return duck(SF_DIR)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()
