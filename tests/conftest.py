import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sellerdesk.session import local_session

    s = local_session(4, shuffle_partitions=8, driver_memory="8g")
    # Tests bring their own shared folder only where the session has none.
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        d = tempfile.mkdtemp(prefix="sellerdesk-test-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


@pytest.fixture
def tmp_folder():
    return tempfile.mkdtemp(prefix="sellerdesk-files-")
