"""A local session with the settings the plans expect."""

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from factlane.scale import SHARED


def local_session(app: str = "factlane", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine; its scratch folder is made here, as it has no other."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config(SHARED, tempfile.mkdtemp(prefix="factlane-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Needed where it isn't installed on them: the driver's own path is not theirs.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        copy = os.path.join(folder, "package")
        shutil.copytree(package, os.path.join(copy, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(os.path.join(folder, "factlane"), "zip", copy)
        kept = os.path.join(tempfile.mkdtemp(prefix="factlane-package-"), "factlane.zip")
        shutil.move(made, kept)
    context.addPyFile(os.path.realpath(kept))
    _shipped.add(context.applicationId)
