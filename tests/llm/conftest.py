import pytest

from sightline import session


@pytest.fixture(autouse=True, scope="session")
def shared(spark):
    """Operators that settle tables need a shared folder."""
    return session.shared_folder(spark)
