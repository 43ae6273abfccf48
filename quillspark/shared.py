"""Building blocks that keep plans safe at scale: scratch tables, hot keys, prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or a temporary one where it is unset (local tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


class Scratch:
    """Written tables in the shared folder; they cut lineage and survive lost executors.

    ``put`` writes a frame and returns it as read back; ``drop`` deletes what ``put``
    returned. What is left is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/quillspark-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.tables: list[str] = []
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def put_counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """:meth:`put` and the number of rows, counted while they are written."""
        seen = Observation()
        out = self.put(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return out, seen.get["n"]

    def bucket(self, df: DataFrame, key: str, buckets: int, by: str | None = None) -> DataFrame:
        """Write ``df`` as a table bucketed and sorted by ``key``: aggregates and joins on the key need no exchange.

        ``by`` divides it into folders besides, so that a filter on it reads only its own files.
        """
        name = f"quillspark_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{self.root}/{name}")
        (writer.partitionBy(by) if by else writer).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def drop(self, *frames: DataFrame) -> None:
        """Delete written frames that nothing reads any more."""
        for df in frames:
            if known := self.paths.pop(id(df), None):
                self._delete(known[1])

    def clear(self) -> None:
        try:
            for name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


def salts_for(spark: SparkSession) -> int:
    """Blocks a hot group is cut into: four per shuffle partition, whose number is set to suit the data."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt_of(*cols: Column | str, salts: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def running_totals(df: DataFrame, group: list[str], order: list[str], weight: Column, name: str, salts: int | None = None) -> DataFrame:
    """The sum of ``weight`` over the rows before each row of its group, exact, without putting a group into one task.

    The order within a group is by (hash salt of ``order``, ``order``): deterministic where
    ``order`` is unique, and balanced for a group that holds a third of all rows. ``df`` is
    read twice: once for the totals per (group, salt), at most groups x salts rows.
    """
    salted = df.withColumn("_salt", salt_of(*order, salts=salts or salts_for(df.sparkSession))).withColumn("_w", weight)
    totals = salted.groupBy(*group, "_salt").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*group, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumn("_rn", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    return ranked.join(offsets, [*group, "_salt"]).withColumn(name, F.col("_off") + F.col("_rn")).drop("_salt", "_rn", "_off", "_w")


def dense_numbers(df: DataFrame, group: list[str], order: list[str], name: str, salts: int | None = None) -> DataFrame:
    """Numbers 0..n-1 within each group; see :func:`running_totals`."""
    return running_totals(df, group, order, F.lit(1).cast("long"), name, salts)


def heavy_keys(df: DataFrame, key: str, total: int, pieces: int | None = None) -> DataFrame:
    """``_hot, _parts``: the keys that hold more than 1 / ``pieces`` of ``total`` rows, and into how many parts they are cut.

    Fewer than ``pieces`` keys can, and their parts sum up to less than twice ``pieces``; it follows the number of
    shuffle partitions (:func:`salts_for`), so the table may be broadcast at every size of the data.
    """
    size = max(total / (pieces or salts_for(df.sparkSession)), 1)
    counts = df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size)
    return counts.filter("_hot IS NOT NULL").select("_hot", F.ceil(F.col("_n") / size).cast("int").alias("_parts"))


def heavy_list(df: DataFrame, key: str, total: int, pieces: int | None = None, least: int = 50_000) -> list[Row]:
    """:func:`heavy_keys` on the driver, for plans that are made round by round: where there are none, nothing has to be spread.

    A key of at most ``least`` rows (of a few numbers each) is no load for a task, so it isn't heavy; neither is any key of so few
    rows in all, and they aren't counted.
    """
    if total <= least:
        return []
    return [r for r in heavy_keys(df, key, total, max(min(pieces or salts_for(df.sparkSession), total // least), 1)).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame | list[Row], how: str = "inner", hint: str | None = None) -> DataFrame:
    """``left`` joined with ``right`` (one row per ``key``, no other column in common) on ``key``, heavy keys in parts.

    ``heavy`` is what :func:`heavy_keys` or :func:`heavy_list` says of ``left``. The rows of a heavy key spread over its parts by their
    other columns, and the one right row is copied to each part, so no task gets a whole hot key.
    """
    if isinstance(heavy, list):
        if not heavy:
            return left.join(right, key, how)
        heavy = left.sparkSession.createDataFrame([tuple(r) for r in heavy], f"_hot {left.schema[key].dataType.simpleString()}, _parts int")
    h = F.broadcast(heavy)
    rest = [c for c in left.columns if c != key] or [key]
    spread = left.join(h, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*rest), "_parts"), F.lit(0)).cast("int"))
    copies = right.join(h, F.col(key) == F.col("_hot"), "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    )
    copies = copies.drop("_hot", "_parts")
    return spread.drop("_hot", "_parts").join(copies.hint(hint) if hint else copies, [key, "_part"], how).drop("_part")
