import glob
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_session

    return get_session("tests", 4)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(frame):
    """Rows of a pandas frame as sorted text, columns by name, doubles to five places."""
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))
