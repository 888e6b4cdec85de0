import os
import shutil
import tempfile

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    own = tempfile.mkdtemp(prefix="quillgrid-tests-")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": own, "spark.checkpoint.dir": f"{own}/shared", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    shutil.rmtree(own, ignore_errors=True)


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
