import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanlab.session import session

    return session("tests", "8", 8, **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
