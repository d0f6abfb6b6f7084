import pytest

from aeroframe.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
