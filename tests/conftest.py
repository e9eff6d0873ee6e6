from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_of(spark):
    """LINES from a list of texts, or from a dict of source -> texts."""

    def make(texts, partitions: int | None = None):
        sources = texts if isinstance(texts, dict) else {"f": texts}
        rows = [(name, 0, i, raw) for name, raws in sources.items() for i, raw in enumerate(raws)]
        frame = spark.createDataFrame(rows, "source_path string, block_start bigint, line_id bigint, raw string")
        return frame.repartition(partitions) if partitions else frame

    return make
