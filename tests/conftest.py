import pytest

from prefixlake.session import build_session, tune


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def mini(spark):
    from tests.fixture import mini_catalog

    return mini_catalog(spark)


@pytest.fixture(scope="session")
def model(mini):
    from prefixlake.plans.suggest import build_model

    return build_model(mini)
