import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from auditspark.session import build_session
    # tests only: a folder of this machine is shared by all of a local session
    s = build_session("local[2]", 4, app="auditspark-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="auditspark-ckpt-")})
    yield s
