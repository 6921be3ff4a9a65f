import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from poicraft.session import build_session
    warehouse = tempfile.mkdtemp(prefix="poicraft-warehouse-")
    s = build_session("local[*]", shuffle_partitions=8,
                      extra_conf={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()
