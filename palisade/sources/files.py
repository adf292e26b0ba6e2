"""File sources: feature CSV, flow CSV, syslog text, tagged log files, JSON lines."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from palisade import schema as S
from palisade.functions.alerts import is_json
from palisade.functions.numbers import count_if
from palisade.functions.text import extract
from palisade.operators.flows import capture_rank, standard_columns
from palisade.operators.ordering import first_per_key
from palisade.session import path_exists, small_side


def labelled_schema() -> T.StructType:
    """Columns of a labelled feature file."""
    kinds = {"timestamp": T.TimestampType(), "window_start": T.TimestampType(), **{f: T.DoubleType() for f in S.FEATURES}}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in S.LABELLED_COLUMNS])


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A feature or label CSV; pass the schema, or the header decides and numbers are read as text first."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_train_test(spark: SparkSession, train: str, test: str, schema=None) -> tuple[DataFrame, DataFrame]:
    return read_features(spark, train, schema), read_features(spark, test, schema)


def _western_marks() -> tuple[str, str]:
    """Characters that ISO-8859-1 leaves as control codes, and what Windows files mean by them."""
    pairs = [(chr(code), bytes([code]).decode("cp1252", "ignore")) for code in range(0x80, 0xA0)]
    known = [(a, b) for a, b in pairs if b]
    return "".join(a for a, _ in known), "".join(b for _, b in known)


def decoded_name(name: str) -> str:
    """A header cell that was read byte by byte."""
    raw = name.encode("iso-8859-1")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def decoded(column):
    """Text that was read byte by byte: UTF-8 where its bytes are that, else the Windows code page."""
    raw = F.encode(column, "ISO-8859-1")
    western = F.translate(column, *_western_marks())
    text = F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(western)
    return F.when(column.rlike(r"[^\x00-\x7F]"), text).otherwise(column)


PLACE = ["_file", "_block"]


def placed(raw: DataFrame) -> DataFrame:
    """Rows of a file scan with their file, block and read order."""
    return raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_read_order"),
    )


def numbered_rows(rows: DataFrame, name: str) -> DataFrame:
    """Add the 0-based number of each placed row in its file, by sums over the blocks of the file.

    A block is read by one task, row after row, so the place of a row in its block is the distance of its read order
    from the first one there. One pass counts the rows of each block; nothing but these counts is ever sorted. Both
    passes have to see the same blocks: a row that does not fit into its block raises an error.
    """
    counts = rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_rows"), F.min("_read_order").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # blocks of a file
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    joined = rows.join(small_side(offsets), PLACE, "left")
    inside = F.col("_read_order") - F.col("_first")
    fits = (inside >= 0) & (inside < F.col("_rows"))
    number = F.when(F.coalesce(fits, F.lit(False)), F.col("_before") + inside).otherwise(
        F.raise_error(F.lit("the blocks of a file changed while it was read")).cast("long"))
    return joined.withColumn(name, number).drop("_rows", "_first", "_before", "_read_order", *PLACE)


def read_flows(spark: SparkSession, path, encoding: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Flow CSV with short column names, file name and row number; empty rows are dropped.

    Without an ``encoding`` fields are read byte by byte and decoded one by one, UTF-8 first, so files of several
    encodings need one pass.
    """
    raw = spark.read.option("header", True).option("encoding", encoding or "ISO-8859-1").csv(path)
    read = raw.columns
    named = placed(raw.select("*", F.col("_metadata")).withColumn("source_file", F.col("_metadata.file_name"))).drop("_metadata")
    if encoding is None:
        names = [decoded_name(c) for c in read]
        named = named.select(*[decoded(F.col(f"`{c}`")).alias(n) for c, n in zip(read, names)], "source_file", *PLACE, "_read_order")
        read = names
    numbered = numbered_rows(named, "row_number")
    if max_rows is not None:
        numbered = numbered.where(F.col("row_number") < max_rows)
    return standard_columns(numbered.dropna("all", subset=[f"`{c}`" for c in read]))


def discover_files(spark: SparkSession, folders, pattern: str = "*.csv") -> DataFrame:
    """(file_name, path, priority, rank): each file name from the first folder that holds it, in capture order.

    Folders that are not there are skipped.
    """
    found = spark.createDataFrame([], "file_name string, path string, priority int")
    for priority, folder in enumerate(folders):
        if not path_exists(spark, folder):
            continue
        listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
            "recursiveFileLookup", True).load(folder)
        listed = listed.select(
            F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.lit(priority).alias("priority"))
        found = found.unionByName(listed)
    kept = first_per_key(found, ["file_name"], ["priority", "path"])
    return kept.withColumn("rank", capture_rank(F.col("file_name"))).orderBy("rank", "file_name")


def read_log_lines(spark: SparkSession, path, max_lines: int | None = None) -> DataFrame:
    """(source_file, line_number, line): trimmed, empty lines skipped, numbered in file order."""
    raw = placed(spark.read.text(path).select("value", F.col("_metadata"))).select(
        F.trim("value").alias("line"), F.col("_metadata.file_name").alias("source_file"), *PLACE, "_read_order")
    numbered = numbered_rows(raw, "line_number")
    if max_lines is not None:
        numbered = numbered.where(F.col("line_number") < max_lines)
    return numbered.where("line <> ''").select("source_file", "line_number", "line")


def read_attackers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct attacker addresses from a label CSV with ``attacker_ip`` or ``ip``."""
    table = spark.read.option("header", True).csv(path)
    column = "attacker_ip" if "attacker_ip" in table.columns else "ip"
    return table.select(F.col(column).alias("attacker_ip")).dropna().distinct()


def split_json_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines that are JSON, and the rest; empty lines belong to neither."""
    trimmed = lines.withColumn(column, F.trim(column)).where(F.col(column) != "")
    return trimmed.where(is_json(F.col(column))), trimmed.where(~is_json(F.col(column)))


def ingest_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    good = is_json(F.trim(column))
    filled = lines.where(F.trim(column) != "")
    return filled.agg(count_if(good).alias("accepted"), count_if(~good).alias("rejected"))


def tag_lines(lines: DataFrame, **tags) -> DataFrame:
    """Constant labels such as host, environment or agent type on every line."""
    return lines.withColumns({name: F.lit(value) for name, value in tags.items()})


def stream_log_files(spark: SparkSession, folder: str, pattern: str = "*.log", **tags) -> DataFrame:
    """New log files of a folder as a stream, tagged."""
    lines = spark.readStream.option("pathGlobFilter", pattern).text(folder)
    return tag_lines(lines.withColumnRenamed("value", "raw_log"), **tags)


def stream_json_lines(spark: SparkSession, folder: str, files_per_batch: int = 500) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def first_address(lines: DataFrame, column: str = "raw_log") -> DataFrame:
    return lines.withColumn("src_ip", extract(F.col(column), r"(\b(?:\d{1,3}\.){3}\d{1,3}\b)"))
