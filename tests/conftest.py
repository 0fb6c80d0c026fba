import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from flowlens.session import local_session, require_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "flowlens-tests")
    require_checkpoint_dir(session)
    yield session
    session.stop()
