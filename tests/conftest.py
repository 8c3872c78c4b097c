import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from keyfold.session import session

    s = session(
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="2",
        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}",
        spark__driver__memory="3g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
