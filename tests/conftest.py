import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronica import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session.build(
        "local[8]",
        "tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    yield built
    built.stop()
