"""Where intermediate files go: the shared folder that the session names, which every executor reaches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from tensorfold.errors import NoWorkspace


def workspace(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a folder of this process's own, removed at its end, and only if all tasks run in this process too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise NoWorkspace("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"tensorfold-{os.getuid()}-{spark.sparkContext.applicationId}")
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def local_folder(spark: SparkSession, name: str) -> str:
    """A folder in the workspace as a path that ``open`` takes; the workspace must be a mount then."""
    top = workspace(spark)
    if "://" in top and not top.startswith("file://"):
        raise NoWorkspace(f"{top} is no path that archives can be written to: they need a mounted folder")
    return os.path.join(top.removeprefix("file://").removeprefix("file:"), name)
