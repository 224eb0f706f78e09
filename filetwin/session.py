"""Session settings and the shared folder that long-lived intermediate tables go to."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def local_session(cores: str = "8", app: str = "filetwin", **conf) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8" if cores == "*" else cores,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.dataFrameQueryContext.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from `spark.checkpoint.dir`.

    Only a local session may go without that setting; it then gets a folder of its own.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app_id = spark.sparkContext.applicationId
    if app_id not in _own_dirs:
        _own_dirs[app_id] = tempfile.mkdtemp(prefix="filetwin-")
    return _own_dirs[app_id]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared one."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def path_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def run_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """The name of the run that a stream's checkpoint stands for; later runs sort behind earlier ones.

    It lies in the checkpoint, so a stream that goes on keeps its run and a new checkpoint has another.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir}/run")
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.exists(path):
        file = store.open(path)
        found = file.readUTF()
    else:
        found = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        file = store.create(path, False)
        file.writeUTF(found)
    file.close()
    return found


def drop_intermediate(spark: SparkSession) -> int:
    """Deletes the folders this session made; call it when results that read them are stored."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(made)


def discard(table: DataFrame) -> None:
    """Deletes a table of `materialize` that nothing will read again; folders this session did not make stay."""
    spark = table.sparkSession
    made = _made.get(spark.sparkContext.applicationId, [])
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    names = {file.rsplit("/", 2)[-2] for file in table.inputFiles()}
    for folder in [m for m in made if os.path.basename(m) in names]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        made.remove(folder)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """`df` as a written table in the shared folder.

    For intermediate results used more than once: they are computed once, survive lost executors,
    and their size is known to the joins that follow.
    """
    target = fresh_dir(df.sparkSession, label)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
