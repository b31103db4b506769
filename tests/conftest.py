import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lineloom import get_spark
    s = get_spark("tests", 8, 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from lineloom.session import drop_scratch
    drop_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def small(spark):
    from lineloom.sources.tables import Tables
    return Tables(spark, "/root/testdata/sf0.001")
