"""Reading the corpus tables and keeping intermediate results.

Intermediate results that are used more than once, or that end a long lineage,
are written as Parquet below the folder that the session names in
``spark.checkpoint.dir``, which all executors share.  They survive the loss of any
executor.  Only where the setting is absent, and the session is one machine's, is a
folder made on it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with a part for this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="attestra-")
        _OWN[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended; the folder's owner clears it
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, *tables: DataFrame) -> str:
    """name, with underscores before it until no column of the tables is called so, in capitals or not."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release(df: DataFrame) -> None:
    """Delete what kept() wrote, once nothing will read it any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _remove(df.sparkSession, f)


def documents_only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of docs, whatever else it carries; a missing one is an error that names it."""
    missing = [c for c in columns if c not in docs.columns]
    if missing:
        raise ValueError(f"documents lack the columns {missing}; they have {docs.columns}")
    return docs.select(*[F.col(f"`{c}`") for c in columns])
