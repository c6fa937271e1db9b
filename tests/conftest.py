import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagemill.session import local_session

    os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")
    s = local_session("pagemill-tests", cpus=4, checkpoint_dir=tempfile.mkdtemp(prefix="pagemill-ck-"))
    yield s
    s.stop()
