import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="loglens-tests-")
    os.environ["LOGLENS_SCRATCH"] = scratch
    from loglens.session import build_session

    s = build_session("local[4]", app_name="loglens-tests", shuffle_partitions=4,
                      extra={"spark.local.dir": scratch})
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    return tempfile.mkdtemp(prefix="case-", dir=os.environ["LOGLENS_SCRATCH"])
