"""File sources and sinks: CSV exports, discovery, ragged sheets, typed reads."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload import dims, schema
from caseload.sources.csv_scan import CsvScan

# Fixed values. Name patterns of chat report files inside the chats folder.
CHAT_REPORT_PATTERN = (
    r".*(agents_performance|chat_rating|total_chats|chat_engagement|chat_duration|tags_usage"
    r"|prechat|chats_report).*\.csv")
TICKET_FILE_PATTERN = r".*\.csv(\.processed)?"
CHAT_WORDS = ["chat", "livechat", "conversation"]


def read_tickets_csv(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """Every column as text, null tokens as NULL, union by name over differing headers.

    ``paths`` is a folder, looked through for CSV files, or a list of files or patterns. Files that can't be read
    are left out with a warning; ``CsvScan(...).files`` has them all with the reason. ``multi_line=False`` says that
    no cell has a line break.
    """
    df = CsvScan(spark, paths, multi_line).checked()
    text = lambda c: F.when(~c.isin(dims.NULL_TOKENS), c)
    return df.select(*[text(schema.physical(c)).alias(c) for c in df.columns])


def read_chats_csv(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """Union by name; types come from the canonical schema, not from inference."""
    return CsvScan(spark, paths, multi_line).checked()


def list_files(spark: SparkSession, base: str, pattern: str = "*.csv*") -> DataFrame:
    """Path, size and time of files below a folder; file contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(base)
        .select("path", "length", "modificationTime")
    )


def classify_files(files: DataFrame) -> DataFrame:
    """S3: ``kind`` of each file from its folder and name; ``length`` stays, so a caller may leave out small files.

    Inside ``tickets/`` and ``chats/`` the folder decides, elsewhere words in the name do.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    folder = F.element_at(F.split("path", "/"), -2)
    has_word = reduce(lambda a, b: a | b, [name.contains(w) for w in CHAT_WORDS])
    kind = (
        F.when(folder == "tickets", F.when(name.rlike(f"^{TICKET_FILE_PATTERN}$"), "tickets"))
        .when(folder == "chats", F.when(name.rlike(f"^{CHAT_REPORT_PATTERN}$"), "chats"))
        .when(name.rlike(r"^.*\.csv$"), F.when(has_word, "chats").otherwise("tickets"))
    )
    return files.withColumn("kind", kind).where(F.col("kind").isNotNull())


def discover(spark: SparkSession, base: str) -> DataFrame:
    """S3."""
    return classify_files(list_files(spark, base))


def latest_export(files: DataFrame, base: str) -> DataFrame:
    """Name of the newest entry below ``base``: a file, or a folder of part files written by Spark.

    Ties go to the greater name.
    """
    rest = F.regexp_extract("path", r"(?:^|/)" + re.escape(base.strip("/").split("/")[-1]) + r"/([^/]+)", 1)
    entries = files.groupBy(rest.alias("entry")).agg(F.max("modificationTime").alias("changed"))
    newest = F.max_by("entry", F.struct("changed", "entry"))
    return entries.where("entry <> ''").agg(newest.alias("entry"))


def latest_table(spark: SparkSession, base: str) -> DataFrame:
    """The newest CSV export as a table of text columns."""
    entry = latest_export(list_files(spark, base, "*.csv"), base).first()["entry"]
    if entry is None:
        raise FileNotFoundError(f"no CSV file below {base}")
    return CsvScan(spark, f"{base.rstrip('/')}/{entry}").checked()


def read_ragged(lines: DataFrame, header: list[str], sep: str = ",", col: str = "value") -> DataFrame:
    """Short rows are padded with empty text, long rows are cut to the header."""
    width = len(header)
    cells = F.split(F.col(col), "\\" + sep, -1)
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)
    return lines.withColumn("_c", padded).select(
        *[F.element_at("_c", i + 1).alias(name) for i, name in enumerate(header)])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header. Nested columns are written as JSON text."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    (df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
     .csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
          ignoreTrailingWhiteSpace=False))


# Fixed values. Dates in file names, tried in this order.
FILE_DATE_PATTERNS = [r"(\d{8})", r"(\d{2}[-_]\d{2}[-_]\d{4})", r"(\d{4}[-_]\d{2}[-_]\d{2})"]


def file_date(path):
    """ST2: date in a file name: ``ddMMyyyy``, ``dd-MM-yyyy``, ``yyyy-MM-dd`` or ``yyyyMMdd``.

    Eight digits that start with 20 are read as year first.
    """
    name = F.element_at(F.split(path, "/"), -1)
    digits = F.coalesce(*[
        F.nullif(F.regexp_replace(F.regexp_extract(name, p, 1), "[-_]", ""), F.lit(""))
        for p in FILE_DATE_PATTERNS])
    year_first = digits.startswith("20")
    ts = F.when(year_first, F.try_to_timestamp(digits, F.lit("yyyyMMdd"))).otherwise(
        F.try_to_timestamp(digits, F.lit("ddMMyyyy")))
    return ts.cast("date")
