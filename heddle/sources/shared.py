"""Where intermediate tables go: a folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, deleted when the application ends.

    Only where that is unset on one machine, as in tests, a local folder is set; on a cluster it must be set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = sc._jsc.sc().getCheckpointDir()
        base = jdir.get() if jdir.isDefined() else None
    if not base:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/heddle-checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    path = os.path.join(base, f"heddle-{uuid.uuid4().hex}")
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path
