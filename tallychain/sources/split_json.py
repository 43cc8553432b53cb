"""Arrays inside large JSON files, read by many tasks.

A whole JSON document as one row ends at 2 GB and is parsed by one task.  Here a file is read as
text cut at the byte that closes an item, so that Spark splits it like any text file: each row is
an item of an array with what stands before it.  Before the first item of an array that is the
array's name; all later items of a split, and of the splits after it, belong to that name until
the next one.  Names are carried inside a split by a window over its rows, and from split to split
over one row per split.

Documents hold one array (or array of arrays) per name, with items of numbers and no brackets
or braces inside strings; values outside arrays are passed over.  A file that ends inside an item
is an error, as is an item that does not parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Opening and closing bytes of the items.
LISTS, OBJECTS = "[]", "{}"


def array_items(spark: SparkSession, path: str, brackets: str) -> DataFrame:
    """``name, item``: the JSON text of each item of each array, in the files below ``path``."""
    first, last = brackets
    cut = rf"(?s)^(.*?)(\{first}[^\[\]{{}}]*)?$"
    rows = spark.read.option("lineSep", last).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        # Grows along the rows of a split.
        F.monotonically_increasing_id().alias("at"),
        F.regexp_extract("value", cut, 1).alias("before"),
        F.regexp_extract("value", cut, 2).alias("open"),
    )
    name = F.regexp_extract("before", r'(?s)"(\w+)"\s*:\s*\[?\s*$', 1)
    # A bracket with nothing behind it opens an empty array, one with nothing before it the document.
    is_item = F.col("open").rlike(r"(?s)^.\s*\S") & F.col("before").rlike(r"\S")
    rows = rows.select(
        "file", "split", "at", F.when(name != "", name).alias("own"),
        F.when(is_item, F.col("open")).alias("open"),
    )
    along = Window.partitionBy("file", "split").orderBy("at")
    inside = rows.withColumn("here", F.last("own", ignorenulls=True).over(along))
    splits = rows.groupBy("file", "split").agg(
        F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("leaves"),
        F.max_by(F.col("open").isNotNull(), "at").alias("torn"),
    )
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("split").rowsBetween(1, 1)
    is_last = F.count("split").over(after) == 0
    carried = splits.select(
        F.col("file").alias("f"), F.col("split").alias("s"),
        F.last("leaves", ignorenulls=True).over(before).alias("carried"),
        F.when(is_last & F.col("torn"), F.raise_error(F.concat(F.lit("the file ends inside an item: "), "file")))
        .cast("boolean").alias("checked"),
    )
    joined = inside.join(carried, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    # The check runs with every row of its split.
    named = joined.where(F.col("checked").isNull() & F.col("open").isNotNull())
    return named.select(
        F.coalesce("here", "carried").alias("name"), F.concat("open", F.lit(last)).alias("item")
    )
