import pytest

from belegwerk.llm.pii import KEY_SETTING


@pytest.fixture(scope="session", autouse=True)
def pseudonym_key(spark):
    spark.conf.set(KEY_SETTING, "a key of the tests")
