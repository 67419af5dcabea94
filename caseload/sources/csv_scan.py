"""CSV exports of any size and with any headers, read as one distributed scan.

The first record of every file is found by all tasks and files are grouped by it as data: the driver sees the
distinct headers, never a list of paths. Rows come from Spark's CSV scan, which splits large files, with one
schema as wide as the widest header; a cell's name follows from the header of its file.

Only files with line breaks inside quoted cells need more, as a split can begin inside a cell. Every line is a
function on the state "inside a quoted cell": it keeps it, turns it round or sets it. Running sums inside a
block, and a fold over the blocks of a file, give the state in which each line begins, and lines that begin
inside a cell are joined to their record.
"""

from __future__ import annotations

import csv
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseload.session import scratch_path

CSV_OPTIONS = {"escape": '"', "quote": '"', "mode": "PERMISSIVE"}
SMALL = 1_000  # bytes; a processed file below this size holds nothing
_QUOTED = '[^"]*+(?:""[^"]*+)*+'
_CELLS = f'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
OPENS = f'^{_CELLS}"{_QUOTED}$'  # a line that begins outside a quoted cell ends inside one
STAYS = f'^{_QUOTED}(?:$|"[^,]*+,{_CELLS}"{_QUOTED}$)'  # one that begins inside ends inside


def _load(reader, kind: str, paths: str | list[str], **options):
    if isinstance(paths, str):
        options |= {"recursiveFileLookup": "true", "pathGlobFilter": "*.csv*"}
    return reader.format(kind).options(**options).load(paths)


def existing(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """The given paths that exist, and the others; asks the file system, reads no file."""
    conf, found, missing = spark._jsc.hadoopConfiguration(), [], []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        matches = where.getFileSystem(conf).globStatus(where)
        (found if matches else missing).append(path)
    return found, missing


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, block, seq, line`` with ``outside`` and ``inside``: the state that the line leaves from either."""
    quoted = F.contains("line", F.lit('"'))
    return (
        _load(spark.read, "text", paths)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", "^﻿", "").alias("line"))
        .withColumns({
            "outside": F.when(quoted, F.col("line").rlike(OPENS)).otherwise(False).cast("int"),
            "inside": F.when(quoted, F.col("line").rlike(STAYS)).otherwise(True).cast("int")}))


def _records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, record, text`` of files with quoted breaks, and ``file`` of those whose last quote stays open.

    Files that end inside a cell are left out, so a record is never longer than a cell that was closed.
    """
    spark = lines.sparkSession
    block = Window.partitionBy("file", "block").orderBy("seq")
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum(F.when((F.col("outside") == 1) & (F.col("inside") == 0), 1).otherwise(0)).over(so_far) % 2
    fixed = F.when(F.col("outside") == F.col("inside"), F.col("outside").bitwiseXOR(F.col("turns").cast("int")))
    state = lines.withColumn("turns", turns).withColumn("set", F.last(fixed, ignorenulls=True).over(so_far))

    def after(start: int, turned: Column, fixed_at: Column) -> Column:
        return F.coalesce(fixed_at, F.lit(start)).bitwiseXOR(turned.cast("int"))

    before = lambda s: after(s, F.coalesce(F.lag("turns").over(block), F.lit(0)), F.lag("set").over(block))
    state = state.withColumns({
        "from0": before(0), "from1": before(1),
        "to0": after(0, F.col("turns"), F.col("set")), "to1": after(1, F.col("turns"), F.col("set"))})
    state = state.withColumns({f"n{s}": F.sum(1 - F.col(f"from{s}")).over(so_far) for s in (0, 1)})
    blocks = state.groupBy("file", "block").agg(
        *[F.max_by(f"to{s}", "seq").alias(f"to{s}") for s in (0, 1)],
        *[F.max_by(f"n{s}", "seq").alias(f"n{s}") for s in (0, 1)])
    folded = blocks.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "to0", "to1", "n0", "n1"))).alias("b")).selectExpr(
        "file", """aggregate(b, named_struct('state', 0, 'seen', 0L, 'at', cast(array() as array<struct<block:bigint,start:int,seen:bigint>>)),
            (a, x) -> named_struct(
                'state', if(a.state = 0, x.to0, x.to1),
                'seen', a.seen + if(a.state = 0, x.n0, x.n1),
                'at', concat(a.at, array(named_struct('block', x.block, 'start', a.state, 'seen', a.seen))))) AS f""")
    open_end = folded.where("f.state = 1").select("file")
    starts = folded.where("f.state = 0").select("file", F.explode("f.at").alias("s")).select("file", "s.block", "s.start", "s.seen")
    number = F.col("seen") + F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "line")))
    made = (
        state.join(starts, ["file", "block"]).select("file", number.alias("record"), "block", "seq", "line")
        .groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))
        .where(F.trim("text") != ""))
    path = scratch_path(spark, "records")
    made.write.parquet(path)
    return spark.read.parquet(path), open_end


def names_of(header: str) -> list[str]:
    """Column names of a header record; a repeated name gets a number, an empty one its place."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([header], strict=False)) if "\n" not in header else
                             next(csv.reader(header.splitlines(keepends=True)))):
        base, n = name or f"_c{i}", 0
        while (f"{base}.{n}" if n else base) in out:
            n += 1
        out.append(f"{base}.{n}" if n else base)
    return out


class CsvScan:
    """The rows of CSV files, and what became of every file.

    ``files`` has file, length, header (null if skipped) and reason (null if read): ``empty``, ``small processed
    file`` or ``unclosed quote``; Spark lists no file of no bytes. ``rows`` has all columns of all headers as text; columns that a file lacks are
    null there, and the path of their file under the name ``FILE``.
    """

    FILE = "_file"

    def __init__(self, spark: SparkSession, paths: str | list[str], multi_line: bool = True):
        self.missing: list[str] = []
        if not isinstance(paths, str):
            paths, self.missing = existing(spark, paths)
        self.files = self.rows = None
        self.columns: list[str] = []
        if not paths:
            return
        sizes = _load(spark.read, "binaryFile", paths).select(F.col("_metadata.file_path").alias("file"), "length")
        lines = _lines(spark, paths)
        if not multi_line:
            lines = lines.withColumn("outside", F.lit(0))
        first = F.min_by("line", F.when(F.trim("line") != "", F.struct("block", "seq")))
        found = sizes.join(lines.groupBy("file").agg(first.alias("header"), F.max("outside").alias("broken")), "file", "left")
        small = F.lower("file").endswith(".processed") & (F.col("length") < SMALL)
        found = found.withColumn("reason", F.when(small, "small processed file").when(F.col("header").isNull(), "empty"))
        found = self._kept(found, "files")
        records = None
        if not found.where("reason is null and broken = 1").isEmpty():
            broken = found.where("reason is null and broken = 1").select("file")
            records, unclosed = _records(lines.join(broken, "file", "left_semi"))
            heads = records.groupBy("file").agg(F.min_by("text", "record").alias("head"), F.min("record").alias("top"))
            found = self._kept(
                found.join(heads, "file", "left").join(unclosed.withColumn("open", F.lit(True)), "file", "left")
                .withColumn("reason", F.coalesce("reason", F.when(F.col("open"), "unclosed quote")))
                .withColumn("header", F.coalesce("head", "header")).drop("head", "open"), "files")
        else:
            found = found.withColumn("top", F.lit(None).cast("long"))
        read = found.where("reason is null")
        self.files = found.select("file", "length", F.when(F.col("reason").isNull(), F.col("header")).alias("header"), "reason")
        headers = [r[0] for r in read.select("header").distinct().collect()]
        if not headers:
            return
        names = {h: names_of(h) for h in sorted(headers)}
        wide = max(map(len, names.values()))
        cells = ", ".join(f"c{i} string" for i in range(wide))
        rows = (
            _load(spark.read.schema(cells), "csv", paths, header=True, enforceSchema=True, **CSV_OPTIONS)
            .withColumn("file", F.col("_metadata.file_path")).join(read.where("broken = 0").select("file", "header"), "file"))
        if records is not None:
            # The options of from_csv are those of the scan; a line break stays part of its cell.
            parsed = F.from_csv("text", cells, {**CSV_OPTIONS, "lineSep": "\x01"})
            stitched = records.join(read.where("broken = 1").select("file", "header", "top"), "file").where("record > top")
            rows = rows.unionByName(stitched.select("file", "header", parsed.alias("p")).select("file", "header", "p.*"))
        order = list(dict.fromkeys(n for h in names for n in names[h]))

        def cell(name: str) -> Column:
            out = F.lit(None).cast("string")
            places: dict[int, list[str]] = {}
            for h, of in names.items():
                if name in of:
                    places.setdefault(of.index(name), []).append(h)
            for at, of in places.items():
                out = F.when(F.col("header").isin(of), F.col(f"c{at}")).otherwise(out)
            return out if len(places) > 1 or len(next(iter(places.values()))) < len(names) else F.col(f"c{next(iter(places))}")

        self.columns = order
        self.rows = rows.select(*[cell(n).alias(n) for n in order], F.col("file").alias(self.FILE))

    @staticmethod
    def _kept(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(df.sparkSession, label)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def checked(self) -> DataFrame:
        """The rows; files that were left out are named in a warning (some of many), none readable is an error."""
        bad = [] if self.files is None else self.files.where("reason is not null").groupBy("reason").agg(
            F.count("*").alias("n"), F.min("file").alias("file")).collect()
        notes = [f"{r['n']} {r['reason']} ({r['file']})" for r in bad]
        notes += [f"{len(self.missing)} missing ({', '.join(self.missing[:5])})"] if self.missing else []
        if notes:
            warnings.warn(f"files are left out: {'; '.join(notes)}", stacklevel=3)
        if self.rows is None:
            raise ValueError("no readable CSV file")
        return self.rows.drop(self.FILE)
