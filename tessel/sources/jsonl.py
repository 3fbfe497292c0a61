"""Line-delimited JSON tables: scans with schema, line numbers and errors; sinks; manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, *, strict: bool = True) -> DataFrame:
    """Records of some files; blank lines are passed over. strict: a line that does not fit is an error, else it is left out."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json([paths] if isinstance(paths, str) else list(paths))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, blank lines left out. Numbers start at 1.

    Spark's rows carry no line number, so one is made from the partition's first number and the place within
    it; partitions of one file are in file order. Only a count for each partition goes to the driver.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").withColumn("_id", F.monotonically_increasing_id())
    lines = lines.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = lines.groupBy("file", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()
    base, rows = {}, []
    for file, part, n, first in sorted(map(tuple, sizes)):
        rows.append((file, part, base.get(file, 0) - first + 1))
        base[file] = base.get(file, 0) + n
    offsets = spark.createDataFrame(rows, "file string, _part long, _base long")
    return lines.join(F.broadcast(offsets), ["file", "_part"]).select("file", (F.col("_at") + F.col("_base")).alias("line_no"), F.col("value").alias("line")).where(F.trim("line") != "")


def parse_lines(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """The record of each line as columns beside file and line_no; a line that is no object is an error that names its place."""
    parsed = lines.withColumn("_r", F.from_json("line", schema))
    bad = ~F.trim("line").startswith("{") | F.col("_r").isNull()
    place = F.concat(F.lit("not a JSON object: "), F.col("file"), F.lit(":"), F.col("line_no").cast("string"))
    return parsed.withColumn("_r", F.when(bad, F.raise_error(place).cast(parsed.schema["_r"].dataType)).otherwise(F.col("_r"))).select("file", "line_no", "_r.*")


def titles(lines: DataFrame) -> DataFrame:
    """Titles of lines that are plain text or objects with a title."""
    line = F.trim("line")
    title: Column = F.when(line.startswith("{"), F.get_json_object(line, "$.title")).otherwise(line)
    return lines.select("line_no", F.trim(title).alias("title")).where("title <> ''")


def discovered(parts: Sequence[DataFrame]) -> DataFrame:
    """Titles of several sources in their order, each at its first sight."""
    out: DataFrame | None = None
    for i, part in enumerate(parts):
        one = part.select("title", F.struct(F.lit(i).alias("source"), F.col("line_no").alias("line_no")).alias("at"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("title").agg(F.min("at").alias("at"))


def sorted_json(df: DataFrame) -> Column:
    """Each row as JSON with its keys in alphabetical order; nulls are written (K1)."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as lines of JSON with sorted keys, non-ASCII characters as they are (K1, K2)."""
    df.select(sorted_json(df).alias("value")).write.mode(mode).text(path)


def append_missing(new: DataFrame, spark: SparkSession, path: str, key: str) -> int:
    """Appends rows whose key the table at path lacks, and returns how many (K3, J6). The new rows are written once and counted from what was written."""
    try:
        have = spark.read.parquet(path).select(key)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        have = None
    rows = new if have is None else new.join(have, key, "left_anti")
    before = 0 if have is None else have.count()
    rows.dropDuplicates([key]).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


#: Bytes of a file that a task may hold to take its digest; a larger one is read as a stream.
WHOLE_BYTES = 32 << 20


def manifest(spark: SparkSession, path: str, *, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """File name, bytes and SHA-256 of the files of a folder (K6); a file of a table in several parts is named with its table.

    Files of at most whole_bytes are read by the tasks, a cell each. No part of a digest can be made apart, so larger ones
    run through the driver's JVM as streams, of which it holds a buffer.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    name, above = F.element_at(parts, -1), F.element_at(parts, -2)
    shown = F.when(above.endswith(".jsonl"), F.concat_ws("/", above, name)).otherwise(name).alias("path")
    small = files.where(F.col("length") <= whole_bytes).select(shown, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select(shown, F.col("length").alias("bytes"), F.col("path").alias("at")).collect()
    if not large:
        return small
    return small.unionByName(spark.createDataFrame([(r["path"], r["bytes"], _streamed_sha256(spark, r["at"])) for r in large], "path string, bytes long, sha256 string"))


def _streamed_sha256(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
