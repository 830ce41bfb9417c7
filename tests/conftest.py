import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("CURATA_SCRATCH", tempfile.mkdtemp(prefix="curata-tests-"))
    from curata.session import local_session

    s = local_session("*", shuffle_partitions=8, app="curata-tests")
    yield s


def rows(df, *cols):
    """Rows as plain tuples (selected columns, sorted)."""
    out = [tuple(r[c] for c in cols) for r in df.collect()] if cols else [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))
