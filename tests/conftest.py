import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from creditlake.session import get_spark
    scratch = tempfile.mkdtemp(prefix="creditlake-test-")
    s = get_spark("local[8]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                         "spark.driver.memory": "8g"})
    yield s
    s.stop()
