"""Column helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.session import ship, written

# The blanks that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def with_text_columns(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable],
    added: T.StructType,
    keep_text: bool = True,
    many: bool = False,
) -> DataFrame:
    """``df`` with the columns ``added``, which a Python function derives from ``text`` row by row.

    ``make`` is called once per task and gives the function of a text, or with ``many`` of a list of texts. Rows go through Arrow batches and stay where they are;
    other columns pass through untouched, those with the name of an added one are replaced.
    """
    names = set(added.names)
    kept = [c for c in df.columns if c not in names and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    types = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches):
        one = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            made = one(texts) if many else [one(t) for t in texts]
            columns = [pa.array([m[i] for m in made], type=t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + columns, names=[*kept, *added.names])

    ship(df.sparkSession)
    return df.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def numbered(df: DataFrame, order: Iterable[Column | str], name: str = "pos", label: str = "numbered") -> DataFrame:
    """``df`` with ``name``: the places 0 .. n-1 of its rows in ``order``, without one window over all rows.

    Rows are sorted by a range-partitioned sort and written once with Spark's partition-and-row id, so that
    counting and numbering see the same partitions; each partition then gets the count of those before it
    from a table of one row per partition (its size is bounded by the partition count, not the data).
    Rows equal in ``order`` are numbered in the order of the sort, which is arbitrary among them.
    """
    spark = df.sparkSession
    tagged = written(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), label)
    part = F.shiftright("_mid", 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(ahead, F.lit(0)).alias("_at"))
    out = tagged.join(F.broadcast(offsets), part == F.col("_part"))
    place = F.col("_at") + F.col("_mid") - F.shiftleft(F.col("_part"), 33)
    return out.select(*[F.col(c) for c in df.columns], place.alias(name))
