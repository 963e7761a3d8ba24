import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sluice.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # managed tables (bucketed layouts) go to a private warehouse folder
    s = build_session("local[4]", app="sluice-tests",
                      **{"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="sluice-wh-")})
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Collect a frame as a list of dicts ordered by its first column."""

    def _rows(df, order=None):
        out = [r.asDict() for r in df.collect()]
        key = order or df.columns[0]
        return sorted(out, key=lambda r: (r[key] is None, r[key]))

    return _rows
