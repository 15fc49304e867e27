"""Session helpers: table loading, durable lineage cuts and skew-safe lookups."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "quillmere", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests, the command line and the bench: local, unless ``spark-submit`` names a master."""
    builder = SparkSession.builder if SparkConf().contains("spark.master") else SparkSession.builder.master(f"local[{cores}]")
    builder = (
        builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, base: str, table: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{base}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master that names none.

    Elsewhere a folder of one machine would be lost to the others, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillmere-cp-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder.

    The plan behind ``df`` runs once, however often the result is read, and a lost executor loses nothing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage through a written table in the shared checkpoint folder: compact, and read by column.

    Partitions and order of the rows are not kept; :func:`cut` keeps them.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _KEPT.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Folders of written tables that nobody has cleared yet.
_KEPT: list[str] = []


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that :func:`keep` wrote inside; results must be written or collected by then."""
    before = len(_KEPT)
    try:
        yield
    finally:
        jvm = spark._jvm
        for folder in _KEPT[before:]:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _KEPT[before:]


#: Keys that a lookup spreads at most; their list is broadcast.
MOST_HOT = 100_000


def skew_safe_lookup(
    facts: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size_col: str,
    salt_on: str,
    hot_rows: int = 200_000,
    how: str = "inner",
) -> DataFrame:
    """Join ``facts`` to ``groups`` (unique per key, ``size_col`` = rows of the key among the facts).

    A key of more than ``hot_rows`` rows is spread over ``ceil(size / hot_rows)`` salts on both sides. The list of hot
    keys is broadcast; it holds the ``MOST_HOT`` hottest ones at most, whatever the number of rows. Keys beyond are joined
    as they are, so the list's bound costs speed at worst, never rows. Keys must not be null.
    """
    salts = F.ceil(F.col(size_col) / F.lit(hot_rows)).cast("int")
    # A total order, so that both sides see the same list.
    hot = groups.select(*keys, salts.alias("_salts")).where("_salts > 1").orderBy(F.desc("_salts"), *keys).limit(MOST_HOT)
    left = (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(salt_on)), F.col("_salts")).cast("int")))
        .drop("_salts")
    )
    spread = groups.join(F.broadcast(hot), keys, "left")
    right = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
