"""Places for files that one job writes and another reads, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, one in a temporary folder in
    local mode, as in tests; on a cluster no such folder would be shared, so it is an error."""
    app, folder = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tallyforge-")
        folder = f"file://{_OWN[app]}"
    return f"{folder.rstrip('/')}/tallyforge/{app}/{name}-{uuid.uuid4().hex}"
