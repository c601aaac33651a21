import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import drop_scratch, get_spark, share_code

    session = get_spark("local[4]", 4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    share_code(session)
    yield session
    drop_scratch(session)


@pytest.fixture(scope="session")
def sf():
    return SF
