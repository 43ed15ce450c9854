"""Delimited files with a header row."""

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import HEADERS
from ..functions.text import pieces, strip
from ..operators.components import written
from . import claims as C
from .files import literal, located


def split_values(c: Column) -> Column:
    """The values of a cell that separates several by ; | or a comma."""
    return pieces(c, r"[;|,]")


def rows(files: DataFrame) -> DataFrame:
    """(path, rec_idx, name, email, phone, company, title): stripped cells by concept; null for a column that a file lacks.

    Python's reader goes over each file, as its rows need their order and may span
    lines. A byte order mark, blank lines and extra cells are skipped. A file that is
    not UTF-8 has no rows.
    """
    names = ["path", "rec_idx", *HEADERS]
    schema = pa.schema([("path", pa.string()), ("rec_idx", pa.int32()), *((h, pa.string()) for h in HEADERS)])

    def read(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                try:
                    reader = csv.DictReader(io.StringIO((raw or b"").decode("utf-8-sig"), newline=""))
                    known = {h.strip().lower(): h for h in reader.fieldnames or [] if h}
                    at = {c: next((known[a] for a in aliases if a in known), None) for c, aliases in HEADERS.items()}
                    for i, row in enumerate(reader):
                        out.append((path, i, *((row.get(h) or "").strip() if h else None for h in at.values())))
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], schema=schema)
                            out = []
                except (csv.Error, UnicodeDecodeError):
                    pass
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], schema=schema)

    return files.select("path", "raw").mapInArrow(read, "path string, rec_idx int, " + ", ".join(f"{h} string" for h in HEADERS))


#: Bytes from which a file is split into lines by Spark instead of being read whole by one task.
LARGE_BYTES = 256 << 20
# A row whose quotes are where the format wants them, and the cells of such a row with the comma before each.
ROW = r'\A(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*\z'
CELL = r'(?:\A|,)(?:"(?:[^"]|"")*"|[^,]*)'


def cells(line: Column) -> Column:
    """The cells of a row that ROW fits, unquoted."""
    found = F.transform(F.regexp_extract_all(line, F.lit(CELL), 0), lambda c, i: F.when(i > 0, F.substr(c, F.lit(2))).otherwise(c))
    return F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, number, line) of text files, which are split at line ends and read by as many tasks as their size asks for.

    A line's number is its place in its block and the lines of the blocks before it.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    short = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    uris = [located(spark, p)[1].toString() for p in paths]
    named = spark.createDataFrame([(p, where(u).toUri().toString()) for p, u in zip(paths, uris, strict=True)], "path string, uri string").select("path", short(F.col("uri")).alias("uri"))
    read = spark.read.text([literal(u) for u in uris]).select(short(F.col("_metadata.file_path")).alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = written(read.withColumn("at", F.monotonically_increasing_id()), "lines")
    blocks = lines.groupBy("uri", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("uri", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(starts, ["uri", "block"]).join(named, "uri").select("path", (F.col("at") + F.col("shift")).alias("number"), "line")


def rows_by_line(spark: SparkSession, paths: list[str]) -> DataFrame:
    """rows() of files of any size without line breaks in cells; a file with a line that ROW does not fit, or that is not UTF-8, has none here."""
    lines = written(numbered_lines(spark, paths), "numbered")
    odd = lines.where(~F.col("line").rlike(ROW) | ~F.is_valid_utf8("line")).select("path").distinct()
    heads = F.transform(cells(F.regexp_replace("line", "^\ufeff", "")), lambda h: F.lower(strip(h)))
    first = lines.where("number = 0").join(odd, "path", "left_anti").select("path", heads.alias("heads"))

    def place(aliases: list[str]) -> Column:
        # of several columns of a name the last one counts; 0 for none
        last = lambda a: F.array_position(F.reverse("heads"), a)
        return F.coalesce(*[F.when(last(a) > 0, F.size("heads") - last(a) + 1) for a in aliases], F.lit(0))

    placed = first.select("path", *[place(aliases).cast("int").alias(f"at_{c}") for c, aliases in HEADERS.items()])
    data = lines.where("number > 0 AND line <> ''").join(placed, "path").withColumn("cells", cells(F.col("line")))
    value = lambda c: F.when(F.col(f"at_{c}") > 0, strip(F.coalesce(F.get("cells", F.col(f"at_{c}") - 1), F.lit(""))))
    return data.select("path", (F.col("number") - 1).cast("int").alias("rec_idx"), *[value(c).alias(c) for c in HEADERS])


def extract_delimited(files: DataFrame) -> DataFrame:
    """A record for each row: name, addresses, phones, title and current job."""
    return map_rows(rows(files))


def map_rows(table: DataFrame) -> DataFrame:
    """Records from rows() or from a native scan with the same columns."""
    method = "csv_column"
    emails = split_values(F.col("email"))
    has_job = (F.coalesce("company", F.lit("")) != "") | (F.coalesce("title", F.lit("")) != "")
    current = F.when(has_job, F.array(C.job(F.col("company"), F.col("title"))))
    made = [C.text("full_name", method, F.col("name")), C.texts("emails", method, emails), C.texts("phones", method, split_values(F.col("phone"))), C.text("headline", method, F.col("title")), C.jobs(method, current)]
    return C.records(table, "recruiter_csv", made, emails, F.col("name"), rec_idx=F.col("rec_idx"))
