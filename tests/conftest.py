import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from flowlens.session import get_spark
    s = get_spark("local[*]", 8, extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="flowlens-wh-")})
    yield s
