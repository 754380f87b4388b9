"""Recording listings and folders as tables: what a listing service answered, files below a root, events a file each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxframe.functions.rules import chain

#: Names under which an answer may hold its files, the time of a link without one, the form of a time.
HOLDERS = ("records", "list", "items", "fileList", "rows")
EXPIRES_S = 120.0
TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"
_ITEM = ("fileId", "fileName", "recordStartTime", "recordEndTime", "fileSize", "fileType", "errorMessage", "url", "urlExpireSeconds")


def parse_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """A row per file of each answer (a JSON text in ``body``), with the other columns of ``pages`` and ``fault``.

    A fault is the first of: 'no object', 'code' (not 200), 'no files' (no list of them) for a whole answer, which is one
    row; 'file_id', 'file_size', 'url_expires', 'record_start', 'record_end' for a file. Null rows are right. An answer with
    an empty list has no row. Times lose their T; a missing size is null, a missing expiry the usual one.
    """
    rest = [c for c in pages.columns if c != body]
    data = lambda path: F.get_json_object(F.col(body), path)
    lists = [data("$.data"), *[data(f"$.data.{h}") for h in HOLDERS]]
    items = F.coalesce(*[F.when(F.ltrim(x).startswith("["), x) for x in lists])
    answer = chain((~F.coalesce(F.ltrim(F.col(body)).startswith("{"), F.lit(False)), "no object"), (~F.coalesce(data("$.code") == "200", F.lit(False)), "code"), (items.isNull(), "no files"))
    schema = "array<struct<" + ", ".join(f"{c}: string" for c in _ITEM) + ">>"
    read = pages.select(*rest, answer.alias("_fault"), F.from_json(items, schema).alias("_items"))
    one = read.select(*rest, "_fault", F.explode(F.when(F.col("_fault").isNull(), F.col("_items")).otherwise(F.array(F.lit(None).cast(schema[6:-1])))).alias("_i"))
    text = lambda c: F.trim(F.col(f"_i.{c}"))
    size, expires = F.nullif(text("fileSize"), F.lit("")), F.coalesce(text("urlExpireSeconds"), F.lit(str(EXPIRES_S)))
    seconds = F.expr("try_cast(_expires as double)")
    one = one.withColumn("_expires", expires)
    bad = lambda c: ~F.coalesce(text(c).rlike(TIME), F.lit(False))
    fault = chain(
        (F.col("_fault").isNotNull(), None),
        (F.coalesce(text("fileId"), F.lit("")) == "", "file_id"),
        (~size.rlike(r"^\d+$"), "file_size"),
        (~F.coalesce((seconds > 0) & (seconds < float("inf")), F.lit(False)), "url_expires"),
        (bad("recordStartTime"), "record_start"),
        (bad("recordEndTime"), "record_end"),
    )
    or_empty = lambda c: F.coalesce(F.col(f"_i.{c}"), F.lit(""))
    time = lambda c: F.when(~bad(c), F.translate(text(c), "T", " "))
    return one.withColumn("_size", size).select(
        *rest, text("fileId").alias("file_id"), or_empty("fileName").alias("file_name"), time("recordStartTime").alias("record_start"), time("recordEndTime").alias("record_end"),
        F.expr("try_cast(_size as bigint)").alias("file_size"), or_empty("fileType").alias("file_type"), or_empty("errorMessage").alias("error_message"), or_empty("url").alias("url"), seconds.alias("url_expires_s"),
        F.coalesce("_fault", fault).alias("fault"),
    )


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path``, ``length``, ``modified`` of all files below ``root`` whose name fits the pattern; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def event_store(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Events of a store with a folder a stream and a JSON file an event; files that hold no object are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(f"{root}/*")
    return rows.where("_corrupt is null").drop("_corrupt")


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls written out; part files are gzipped."""
    rows.write.option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_lines`` wrote; a line that does not fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
