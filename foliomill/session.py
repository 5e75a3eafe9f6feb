"""Session helpers: shared checkpoint folder, reliable lineage cuts, table access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "foliomill", cores: str | int = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the one of spark.checkpoint.dir. A temporary one stands in only where all run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="foliomill-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/foliomill-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: survives lost executors, ends lineage and plan.
    What the planner learns is the size of compressed files, so who broadcasts such a table measures its rows first.
    The tables go with the session (release) or with its checkpoint folder."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    _CUTS.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def stored_rows(df: DataFrame) -> int:
    """Rows of a table: of one that cut returned told by its files' footers, without a job; else counted."""
    path = getattr(df, "cut_path", None)
    if path is None:
        return df.count()
    if getattr(df, "cut_rows", None) is None:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".parquet")]
        if len(files) > 500:
            return df.count()
        df.cut_rows = sum(b.getRowCount() for f in files for b in jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(conf, f).getBlocks())
    return df.cut_rows


_CUTS: list[str] = []


def cuts_held() -> int:
    """How many tables of cuts exist by now."""
    return len(_CUTS)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables of the cuts after the first `since`, but for the last `keep`; nothing that reads them may be pending."""
    gone = _CUTS[since : len(_CUTS) - keep]
    del _CUTS[since : since + len(gone)]
    for path in gone:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through the cluster's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: their Python workers import it by name."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="foliomill-"), "foliomill_package.zip")  # the driver serves it from here
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("foliomill", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of a folder; the package is made known to the executors first."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
