import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparkloom.session import session

    made = session(
        "tests", spark_master="local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_ui_showConsoleProgress="false",
        spark_driver_memory="4g", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
