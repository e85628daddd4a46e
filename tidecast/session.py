"""Session helpers.

The library never creates its own cluster settings when a session already
exists: everything is read from the active session. ``local_session`` is only
for tests, benchmarks and the command line, and it sets defaults only where
the user (or a spark-defaults file) left them unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings a local run needs; cluster runs bring their own.
_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cpus: int | str = "*", app: str = "tidecast", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared file system and is used as is.
    Only when it is unset on a local master (tests) is a scratch folder
    chosen; on a cluster executors would each write to their own disk, so an
    unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidecast-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint): the data is written
    to the folder the cluster names, and the plan restarts from there.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a row group of a stored table: small ones can be dealt to many tasks.
STORED_GROUP = 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder. What follows scans the files:
    its plans do not carry the one behind ``df``, and its tasks are as many as
    the files are worth, not one for every shuffle partition of a cache."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", STORED_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literal rows (parameters, weights, categories).

    Built as an inline array of structs over a one-row range, so it plans as
    a local literal relation (no RDD scan, no Python round trip) and joins
    or cross joins against it stay cheap.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, st.fields)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs))).select(*[F.col(f.name).cast(f.dataType) for f in st.fields])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for intermediate
    files (never a machine-local temp folder: on a cluster every executor
    must see it)."""
    import uuid

    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tidecast-scratch/{name}-{uuid.uuid4().hex}"
