"""Session helper for tests and the bench; on a cluster the submitted session is used as is."""

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app: str = "fleetgauge", shuffle_partitions: int = 8):
    scratch = tempfile.mkdtemp(prefix="fleetgauge-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FLEETGAUGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.checkpoint.dir", os.path.join(scratch, "shared"))
        .getOrCreate()
    )
