import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tracelode.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, **{"spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def case(tmp_path_factory):
    """Folder with the six evidence files of the example case."""
    from evidence import build

    folder = tmp_path_factory.mktemp("case")
    build(folder)
    return folder
