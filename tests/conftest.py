import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from courtlake.session import local_session

    return local_session(8, shuffle_partitions=8)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rows(spark):
    """Rows of a DataFrame as sorted tuples."""
    return lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())
