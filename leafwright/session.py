"""Sessions for tests, benches and local use; on a cluster the caller brings its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session may leave it unset and gets a temporary folder;
    on a cluster that would be lost with its machine, so an error is raised.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local") or not folder and context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="leafwright-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """:func:`cut` as compressed columns, a half or a third of its size for texts. The files stay until :func:`release`."""
    path = f"{_checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    forget_shuffles(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a :func:`cut` or :func:`stored` that nothing reads any more; those of a cut otherwise stay until the driver collects garbage."""
    context = df.sparkSession.sparkContext
    file = getattr(df, "_stored", None)
    if file is None:
        checkpoint = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        file = checkpoint.get() if checkpoint.isDefined() else None
    if file:
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    forget_shuffles(df.sparkSession)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no DataFrame leads to any more, as those behind a :func:`cut`; it does so only when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` materialised once and marked for broadcast if it has at most ``rows`` rows, else left to shuffle joins."""
    from pyspark.sql import functions as F

    kept = cut(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


#: Copies of a looked-up table over which a hot key is spread where the table is too large to be broadcast.
SALTS = 16


def lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: int, spread: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key.

    ``right`` is broadcast if it has at most ``rows`` rows. Otherwise both are moved by key and salt: ``right`` is copied for every
    salt and the rows of ``left`` are spread over the salts by a hash of the columns ``spread``, so that a key that holds a
    large share of them doesn't end up in one task. The result is the same either way.
    """
    from pyspark.sql import functions as F

    kept = cut(right)
    if kept.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(kept), keys, how)
    salted = kept.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return mine.join(salted, [*keys, "_salt"], how).drop("_salt")
