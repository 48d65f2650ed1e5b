import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparkweave.session import session

    made = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__ui__showConsoleProgress="false")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
