"""Sample sets: unions, exact-count splits and draws by hash order, summaries, batches.

Draws take rows in the order of a seeded hash, so a seed gives the same rows on any partitioning, and counts are exact.  Ranks inside a
group come from ranges of the full key (see `dense_position`), so a group with most of the rows is not one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import seeded_hash
from ..sources.io import dense_position
from ..sources.shared import stored
from .quantiles import quantiles


def merge_samples(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ranked(df: DataFrame, groups: list[str], id_col: str, seed: int) -> DataFrame:
    """Adds __rank (0-based, by seeded hash) and __n, the size of the group."""
    keyed = df.withColumn("__h", seeded_hash(id_col, F.lit(seed)))
    sizes = stored(df.groupBy(*groups).agg(F.count("*").alias("__n")), "sizes")
    n = sizes.agg(F.sum("__n")).first()[0] or 0
    return dense_position(keyed, groups, ["__h", id_col], n).withColumnRenamed("position", "__rank").drop("__h").join(sizes, groups)


def split_samples(df: DataFrame, r: float = 0.2, g: float = 0.1, exclude: tuple = (), seed: int = 0, group: str = "grp", id_col: str = "sample_id") -> DataFrame:
    """Adds part: excluded groups are valid; of the others ceil((1 - g) * n) are picked, and of their rows ceil((1 - r) * n) train."""
    out = F.col(group).isin(*exclude) if exclude else F.lit(False)
    if g == 0 and not exclude:
        return _ranked(df, [group], id_col, seed).withColumn("part", F.when(F.col("__rank") < F.ceil(F.col("__n") * (1 - r)), "train").otherwise("valid")).select(*df.columns, "part")
    names = df.filter(~out).select(group).distinct()
    picked = dense_position(names.withColumn("__h", seeded_hash(group, F.lit(seed))).withColumn("__all", F.lit(0)), ["__all"], ["__h", group])
    total = names.count()
    kept = stored(picked.filter(F.col("position") < F.ceil(F.lit((1 - g) * total))).select(group), "kept")
    ranked = _ranked(df.filter(~out).join(kept, group, "left_semi"), [group], id_col, seed)
    train = ranked.withColumn("part", F.when(F.col("__rank") < F.ceil(F.col("__n") * (1 - r)), "train").otherwise("valid")).select(*df.columns, "part")
    rest = df.join(kept, group, "left_anti").withColumn("part", F.lit("valid"))
    return train.unionByName(rest)


def sample_groups(df: DataFrame, ratio: float, seed: int = 0, group: str = "grp", id_col: str = "sample_id") -> DataFrame:
    """floor(n * ratio) rows of each group."""
    return _ranked(df, [group], id_col, seed).filter(F.col("__rank") < F.floor(F.col("__n") * ratio)).select(*df.columns)


def select_groups(df: DataFrame, names: list[str], group: str = "grp") -> DataFrame:
    return df.filter(F.col(group).isin(*names))


def except_ids(every: DataFrame, some: DataFrame, id_col: str = "sample_id") -> DataFrame:
    return every.join(some.select(id_col).distinct(), id_col, "left_anti")


def count_summary(df: DataFrame, group: str = "grp", marker: str = "@") -> DataFrame:
    """city (the text before the marker) and its number of samples, sorted."""
    return df.groupBy(F.regexp_extract(group, f"^([^{marker}]*)", 1).alias("city")).agg(F.count("*").alias("n")).orderBy("city")


def quartile_summary(df: DataFrame, value: str) -> DataFrame:
    """median, q1, q3, iqr in one row."""
    q1, middle, q3 = quantiles(df, [value], [0.25, 0.5, 0.75])[value]
    return df.sparkSession.createDataFrame([(middle, q1, q3, None if q1 is None else q3 - q1)], "median double, q1 double, q3 double, iqr double")


def mad(df: DataFrame, value: str, log: bool = False, scale: float = 1.4826) -> DataFrame:
    """scale * median(abs(x - median))."""
    x = df.select((F.ln(value) if log else F.col(value)).alias("x"))
    middle = quantiles(x, ["x"], [0.5])["x"][0]
    off = quantiles(x.select(F.abs(F.col("x") - F.lit(middle)).alias("off")), ["off"], [0.5])["off"][0]
    return df.sparkSession.createDataFrame([(None if off is None else scale * off,)], "mad double")


def three_way_split(df: DataFrame, seed: int = 0, group: str = "grp", id_col: str = "sample_id") -> DataFrame:
    """Adds part: 80 % train, 10 % valid, 10 % test by two splits inside groups."""
    first = split_samples(df, 0.2, 0.0, (), seed, group, id_col).withColumnRenamed("part", "__p")
    rest = split_samples(first.filter("__p = 'valid'").drop("__p"), 0.5, 0.0, (), seed + 1, group, id_col)
    return first.filter("__p = 'train'").withColumnRenamed("__p", "part").unionByName(rest.withColumn("part", F.when(F.col("part") == "train", "valid").otherwise("test")))


def dataset_catalog(df: DataFrame, targets: list[str], features: list[str], group: str = "grp") -> DataFrame:
    """group, column, role, rows, width (longest array, 1 for numbers)."""
    from pyspark.sql import types as T

    wide = [F.max(F.size(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.lit(1)).alias(c) for c in (*targets, *features)]
    one = df.groupBy(group).agg(F.count("*").alias("rows"), *wide)
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.lit("target" if c in targets else "feature").alias("role"), F.col(c).cast("long").alias("width")) for c in (*targets, *features)])
    return one.select(group, "rows", F.explode(parts).alias("p")).select(group, "p.column", "p.role", "rows", "p.width")


def batches(df: DataFrame, size: int, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """Adds batch: rows in seeded hash order, size to a batch; an incomplete last batch goes."""
    n = df.count()
    keyed = df.withColumn("__h", seeded_hash(id_col, F.lit(seed))).withColumn("__all", F.lit(0))
    return dense_position(keyed, ["__all"], ["__h", id_col], n).withColumn("batch", F.floor(F.col("position") / size)).filter(F.col("batch") < n // size).select(*df.columns, "batch")
