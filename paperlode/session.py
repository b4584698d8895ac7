"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is set; on a cluster that is
    an error, as executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(spark, "_paperlode_dir", None)
        if not folder:
            master = spark.sparkContext.master or ""
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="paperlode-")
            spark._paperlode_dir = folder
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the files under the paths: names, sizes and times. Missing ones count as such."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for p in sorted(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            seen += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
        else:
            seen.append((p, -1, -1))
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:32]


def written(df: DataFrame) -> DataFrame:
    """Write as Parquet under the shared folder and read it back: column pruning stays possible."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
