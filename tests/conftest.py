import pytest

from codescan.session import clear_work, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_work(session)
    session.stop()


def rows(df, *columns):
    """Set of tuples of the given columns."""
    return {tuple(r) for r in df.select(*columns).collect()}
