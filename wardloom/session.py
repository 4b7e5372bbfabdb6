"""Session helpers: table access, parallelism and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A temporary folder is set only where the session names none and runs in local mode, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="wardloom-ckpt-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row-wise work at least one partition for each core; larger inputs keep their scan partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def may_contain(df: DataFrame, column: str, keys: DataFrame, key: str, log2_bits: int = 24) -> DataFrame:
    """``df`` without most of the rows whose ``column`` is none of ``keys``; it drops no row whose value is one.

    The filter is one bit for each of 2^``log2_bits`` hash values (2 MB at the default), however many keys there are, so
    it can be broadcast at any scale; it spares the shuffle of rows that a following join would drop.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << log2_bits))
    bits = (
        keys.select(spot(key).alias("h")).groupBy(F.bitmap_bucket_number(F.col("h")).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("h"))).alias("_bits"))
    )
    h = spot(column)
    at = F.bitmap_bit_position(h).cast("int")
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    return (
        df.withColumn("_bucket", F.bitmap_bucket_number(h)).withColumn("_at", at).join(F.broadcast(bits), "_bucket")
        .where(byte.bitwiseAND(F.expr("shiftleft(1, _at % 8)")) != 0)
        .drop("_bucket", "_at", "_bits")
    )


def put(spark: SparkSession, folder: str, files: dict[str, bytes | str]) -> str:
    """Write small files into a folder of the shared checkpoint folder, through the file system it is on; their folder's path."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/{folder}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, content in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
        out.close()
    return root
