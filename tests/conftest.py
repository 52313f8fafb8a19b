import pytest

from sightline import session

# Test modules build Columns at import, so the session exists from the start.
SPARK = session.local(8, 8, "8g")
SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SPARK
    SPARK.stop()
