from __future__ import annotations

import pytest

from driftmark.sources.session import tune
from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    session = tune(make_session())
    yield session
    session.stop()
