"""Session settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",  # JSON objects with a repeated key keep the last value
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName("quaver").config(map=SETTINGS | settings)
    return (b.master(master) if master else b).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of our own in one JVM and the warehouse on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        one_machine = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        folder = tempfile.mkdtemp(prefix="quaver-") if one_machine else spark.conf.get("spark.sql.warehouse.dir")
        if not one_machine and not re.match(r"(?!file:)[a-z][a-z0-9+.-]*://?", folder, re.I):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; {folder} is on each machine's own disk")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, parted by some columns, and read it back; the table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quaver/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
