"""Makes this package importable in Python workers, wherever the driver was started; durable intermediate results."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        home = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "tabulon_source.zip")
        with zipfile.ZipFile(path, "w") as package:
            for folder, _, names in os.walk(home):
                for name in names:
                    if name.endswith(".py"):
                        package.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(home)))
        context.addPyFile(path)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset a temporary one, on one machine (as in tests) only:
    executors elsewhere would write where nobody reads."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to all cores: a small or compact file is read by fewer tasks than long formulas need."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in staged:
        spark, files = df.sparkSession, df.inputFiles()
        home = f"{shared_dir(spark)}/"
        for folder in {f.rsplit("/", 1)[0] for f in files}:
            if re.sub(r"^file:/+", "/", home) in re.sub(r"^file:/+", "/", folder) + "/":
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
