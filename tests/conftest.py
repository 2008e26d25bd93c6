from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_cells(spark):
    """Cells from ``{layer: [rows of values]}`` placed at the top-left corner of a grid."""
    from overgrid.model import CELLS

    def make(layers, grid, left=0, top=0):
        rows = [
            (layer, grid.zoom, (left + i) // grid.tile, (top + j) // grid.tile, left + i, top + j, v)
            for layer, lines in layers.items()
            for j, line in enumerate(lines)
            for i, v in enumerate(line)
            if v != "-"
        ]
        return spark.createDataFrame(rows, CELLS)

    return make
