import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def checkpoint_dir(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(checkpoint_dir):
    from pyspark.sql import SparkSession

    from somagrid.session import build_session

    base = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
    base.config("spark.ui.enabled", "false").config("spark.checkpoint.dir", checkpoint_dir).getOrCreate()
    s = build_session("tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
