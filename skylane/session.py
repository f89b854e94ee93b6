"""Session settings and the durable work area used to cut long lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is hinted for broadcast only after its row count has been taken and lies below this bound.
BROADCAST_ROWS = 100_000
# Sub-keys over which a lookup too large to broadcast spreads the rows of one key.
LOOKUP_COPIES = 16

_local_area: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skylane")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_area(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a one-process master (``local`` or
    ``local[n]``) may fall back to a folder of its own; anywhere else, ``local-cluster`` included, a
    missing setting is an error, because a machine-local path would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if "path" not in _local_area:
        _local_area["path"] = tempfile.mkdtemp(prefix="skylane-")
        atexit.register(shutil.rmtree, _local_area["path"], True)
    return _local_area["path"]


def written(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the work area and return a scan of it.

    Cuts the lineage durably: a lost executor re-reads the table instead of replaying the rounds
    before it. The scan carries true sizes, so later joins choose broadcast by measured size.
    """
    spark = df.sparkSession
    path = f"{work_area(spark)}/{label}-{uuid.uuid4().hex}"
    if partitions is not None:
        df = df.coalesce(partitions)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_counting(df: DataFrame, label: str, condition: Column) -> tuple[DataFrame, int]:
    """As ``written``, with the number of rows that meet ``condition``, observed during the write."""
    seen = Observation(label)
    observed = df.observe(seen, F.count_if(condition).alias("n"))
    table = written(observed, label)
    return table, seen.get["n"]


class KeyedTable:
    """A table that is kept hashed by its key into buckets, so joins and counts by that key move none of its rows.

    Rows are only ever appended. The table lives in the work area and is forgotten by ``drop``; its files stay as
    long as the area keeps them, for readers that hold on to it.
    """

    def __init__(self, spark: SparkSession, label: str, columns: dict[str, str], keys: list[str]):
        self.spark, self.keys, self.columns = spark, keys, list(columns)
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shown = ", ".join(f"{c} {t}" for c, t in columns.items())
        spark.sql(
            f"CREATE TABLE {self.name} ({shown}) USING parquet CLUSTERED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS "
            f"LOCATION '{work_area(spark)}/{self.name}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, placed: bool = False) -> int:
        """Add rows and count them; ``placed`` says that they are hashed by the key already."""
        rows = rows.select(*self.columns)
        if not placed:
            rows = rows.repartition(self.buckets, *self.keys)
        seen = Observation(self.name)
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return seen.get["n"]

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the counted ``rows`` prove the side small; otherwise leave it alone."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# A key counts as hot when it holds at least one row in HOT_SHARE; so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 1000


def shuffled_side(df: DataFrame, rows: int) -> DataFrame:
    """Keep a side that is not counted small out of any broadcast, whatever the size of the files it comes from."""
    return df if rows <= BROADCAST_ROWS else df.hint("merge")


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` as a written table, and its number of rows."""
    return written_counting(df, label, F.lit(True))


def join_answers(rows: DataFrame, answers: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) inner joined to ``answers``, which has one row per ``key``.

    ``weight`` counts the rows of a key. Hot keys are answered by a broadcast, which has at most
    ``HOT_SHARE`` rows whatever the input; what remains has no key above one row in ``HOT_SHARE`` and
    goes through an ordinary join. Both inputs should be written tables, they are read twice.
    """
    is_hot = F.col(weight) * F.lit(HOT_SHARE) >= F.lit(total)
    hot = answers.filter(is_hot)
    cold = answers.filter(~is_hot)
    by_broadcast = rows.join(F.broadcast(hot), key)
    by_shuffle = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return by_broadcast.unionByName(by_shuffle)


def spread_lookup(many: DataFrame, few: DataFrame, key: str, by: str, rows: int, how: str = "inner") -> DataFrame:
    """Join ``few`` (one row per ``key``, ``rows`` of them) to ``many`` without a hot key.

    Broadcast when counted small. Otherwise ``few`` is copied under ``LOOKUP_COPIES`` sub-keys and
    ``many`` picks one by the hash of ``by``, so the rows of one key never meet in a single task.
    The copies are shuffled for certain: Spark would guess their size by the compressed file, before copying.
    """
    if rows <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), key, how)
    copies = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_COPIES - 1))))
    spread = many.withColumn("copy", F.pmod(F.xxhash64(by), F.lit(LOOKUP_COPIES)).cast("int"))
    return spread.join(copies.hint("merge"), [key, "copy"], how).drop("copy")
