import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from featurestats.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="featurestats-tests",
                      checkpoint_dir=tempfile.mkdtemp(prefix="fs-test-ckpt-"))
    yield s
    s.stop()
