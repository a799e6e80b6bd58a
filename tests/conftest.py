import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarry.session import session

    where = tmp_path_factory.mktemp("spark")
    spark = session(
        f"local[{os.environ.get('TEST_CPUS', '4')}]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": f"file://{where}/shared",
            "spark.sql.warehouse.dir": f"{where}/warehouse",
            "spark.driver.extraJavaOptions": f"-Dderby.system.home={where}",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
