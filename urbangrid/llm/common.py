"""Small helpers that the corpus operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path, stored

ARROW_ROWS = 512  # rows in an Arrow batch: bounds a worker's memory when texts are long
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; texts are sent to Python workers in short batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text only (columns of other names cannot clash); a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: cuts the lineage and fixes what later steps see."""
    return stored(df, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(docs: DataFrame, least: int, id_col: str = "doc_id", rows: int = 20_000, most: int = 20_000) -> np.ndarray:
    """Ascending ids that occur and cut the table into even ranges; the last is the greatest id.  Reads the id column only.

    There are about `least` ranges, or one for each `rows` rows where that is more (up to `most`, which bounds what is sent to the tasks), so a range
    stays small as the table grows.  Range r holds the ids above bound r-1 up to bound r (`np.searchsorted`).  Known before the rows are dealt, so
    nothing is read or computed twice to sample them.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    top, n = ids.agg(F.max("id"), F.count("*")).first()
    if top is None:
        return np.empty(0, np.int64)
    ranges = max(least, min(n // rows, most))
    return np.unique(np.array([*map(int, ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)), top], dtype=np.int64))


def likely_among(df: DataFrame, id_col: str, ids: DataFrame, bits: int = 23) -> DataFrame:
    """Rows of df whose id may be among `ids` (one column): none that is goes, few others stay.

    A bitmap of 2^bits hashed ids, a fixed size whatever the number of ids, is or-ed together by Spark and sent to the tasks; a join on the exact ids
    follows, with far less to shuffle than the whole table where the ids are few.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits))
    words = ids.select(place(ids.columns[0]).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS INT))")).alias("b"))
    bitmap = np.zeros((1 << bits) // 64, np.int64)
    table = words.toArrow()  # at most 2^bits / 64 rows
    bitmap[table.column("w").to_numpy()] = table.column("b").to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool))

    @F.pandas_udf("boolean")
    def there(p: pd.Series) -> pd.Series:
        return pd.Series(sent.value[p.to_numpy()])

    return df.filter(there(place(id_col)))
