"""A store of samples under dense keys 0..n-1: bands, auxiliary bands and targets of a sample in one row.

Keys are cut into spans of equal length, a folder for each, and the files of a span are sorted by key.  So asking for keys reads the folders of their
spans and, in them, the row groups whose key range holds one; nothing of the store is held in memory, and no index is kept beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .io import keyed_samples, load_params, save_params

BROADCAST_KEYS = 1_000_000  # 8 MB of keys


def _interleaved(columns: list[Column]) -> Column:
    """One array with the columns' values side by side, cell by cell."""
    names = [f"c{k}" for k in range(len(columns))]
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(columns, names)])
    return F.flatten(F.transform(zipped, lambda s: F.array(*[s[n] for n in names])))


def stack_samples(df: DataFrame, radar: list[str], optical: list[str], aux: list[str], targets: list[str], scale: float = 1e-4) -> DataFrame:
    """Replaces the named columns by bands, aux and targets; all others stay.

    bands: array<double> of rows x columns x bands values; a radar band (decibel) gives 255 times its coefficient, an optical one its value times
    255 * scale.  aux: an array for each auxiliary band, in the order of their names.  targets: array<double>, as listed.  A missing cell is null in
    its place.  Bands that are null or whose sizes differ have no common cells: bands is null for that row, and the row stays.
    """
    named = [*radar, *optical]
    if not named:
        raise ValueError("no band is named")
    taken = {"bands", "aux", "targets", "key", "span"} & (set(df.columns) - {*named, *aux, *targets})
    if taken:
        raise ValueError(f"columns {sorted(taken)} are names of the store")
    # least skips nulls, so a missing radar cell is kept apart
    parts = [F.transform(b, lambda v: F.when(v.isNotNull(), F.least(F.lit(255.0), S.backscatter(v) * 255))) for b in radar]
    parts += [F.transform(b, lambda v: v * (scale * 255)) for b in optical]
    same = reduce(lambda a, b: a & b, (F.size(b) == F.size(named[0]) for b in named), F.col(named[0]).isNotNull())
    rest = [c for c in df.columns if c not in {*named, *aux, *targets}]
    doubles = lambda c: F.col(c).cast("array<double>")
    return df.select(
        *rest,
        F.when(same, _interleaved(parts)).alias("bands"),
        F.array(*map(doubles, sorted(aux))).cast("array<array<double>>").alias("aux"),
        F.array(*[F.col(t).cast("double") for t in targets]).cast("array<double>").alias("targets"),
    )


def write_store(df: DataFrame, path: str, order: list[str], span: int = 100_000) -> int:
    """Writes the rows under keys in the given order, `span` keys to a folder, and returns their number.

    Keys come from ranges of the order (see io.dense_position), whose rows lie together already: they are sorted and written without another shuffle.
    """
    spark = df.sparkSession
    keyed = keyed_samples(df, order).withColumn("key", F.col("key").cast("long")).withColumn("span", F.floor(F.col("key") / span).cast("long"))
    keyed.sortWithinPartitions("span", "key").write.mode("overwrite").partitionBy("span").parquet(f"{path}/samples")
    spark.createDataFrame([], keyed.schema).write.mode("overwrite").parquet(f"{path}/layout")
    n = _samples(spark, path).count()
    save_params({"n": n, "span": span}, f"{path}/meta", spark)
    return n


def _samples(spark: SparkSession, path: str) -> DataFrame:
    """The layout is kept as a table without rows, as an empty store has no file that bears it."""
    return spark.read.schema(spark.read.parquet(f"{path}/layout").schema).parquet(f"{path}/samples")


def _span(spark: SparkSession, path: str) -> int:
    return int(load_params(f"{path}/meta", spark)["span"])


def store_size(spark: SparkSession, path: str) -> int:
    return int(load_params(f"{path}/meta", spark)["n"])


def read_store(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of keys begin <= key < end (the whole store where neither is given); spans outside are not listed for reading."""
    df, width = _samples(spark, path), _span(spark, path)
    if begin is not None:
        df = df.filter((F.col("key") >= begin) & (F.col("span") >= begin // width))
    if end is not None:
        df = df.filter((F.col("key") < end) & (F.col("span") <= (end - 1) // width))
    return df.drop("span")


def get(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """Rows of a list of keys, as a training step asks for them; a key that is listed twice or not held gives one row or none."""
    width = _span(spark, path)
    asked = sorted(set(map(int, keys)))
    df = _samples(spark, path)
    return df.filter(F.col("span").isin(sorted({k // width for k in asked})) & F.col("key").isin(asked)).drop("span")


def lookup(spark: SparkSession, path: str, asked: DataFrame, key: str = "key") -> DataFrame:
    """Each row of `asked` with the sample of its key; nulls where the store has none.

    A table of at most BROADCAST_KEYS keys is sent to the tasks, and the spans it names are the only ones read (dynamic partition pruning); a
    larger one is joined by key in a shuffle.
    """
    width = _span(spark, path)
    clash = set(asked.columns) & (set(_samples(spark, path).columns) - {"key", "span"})
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in both tables")
    own = _samples(spark, path).withColumnRenamed("key", "__key").withColumnRenamed("span", "__span")
    keys = asked.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__k")).distinct().withColumn("__s", F.floor(F.col("__k") / width).cast(own.schema["__span"].dataType))
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    found = own.join(F.broadcast(keys) if few else keys, (F.col("__span") == F.col("__s")) & (F.col("__key") == F.col("__k")))
    return asked.join(found.drop("__span", "__s", "__k"), F.col(key).cast("long") == F.col("__key"), "left").drop("__key")
