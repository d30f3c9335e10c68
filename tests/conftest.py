import pytest

from wattsift.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rows(spark):
    """rows("a int, b string", (1, "x"), ...) -> DataFrame."""

    def build(schema, *values):
        return spark.createDataFrame(list(values), schema)

    return build


def collected(df, *columns):
    names = columns or df.columns
    return sorted([tuple(r) for r in df.select(*names).collect()], key=repr)
