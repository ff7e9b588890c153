import pytest

from urlrisk.session import local_session
from urlrisk.sources.registry import core_registry


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


@pytest.fixture(scope="session")
def registry(spark):
    return core_registry(spark)
