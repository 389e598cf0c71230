from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=4, memory="4g")
    ship_package(session)
    return session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
