import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lociframe.scale import session


@pytest.fixture(scope="session")
def spark():
    spark = session(4, 4)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples of the listed columns."""
    def collect(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    return collect
