"""Bank statements in and out: CSV of any header style, JSON, and the two writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.functions.parsing import blank_to_null, parse_amount, strip, with_ts
from lendgrain.session import settle

MOST_COLUMNS, BROADCAST_FILES = 64, 100_000
STATEMENT_JSON = (
    "applicant_id BIGINT, opening_balance DOUBLE, transactions ARRAY<STRUCT<date STRING, value_date STRING, "
    "description STRING, cheque_no STRING, debit DOUBLE, credit DOUBLE, balance DOUBLE, branch_code STRING, "
    "failed BOOLEAN>>"
)


def parse_statements(raw: DataFrame, keys: tuple[str, ...] = ("applicant_id", "seq")) -> DataFrame:
    """All-text rows with whatever headers the bank used, as typed transactions.

    Headers are trimmed and lowercased; of several known names for a field the first
    non-blank value counts. A ``type`` column with an ``amount`` beats debit and credit
    columns. A row stays if its date parses, or if it is typed with a positive amount:
    such a row keeps a null timestamp and is marked.
    """
    frame = raw.toDF(*[c.strip().lower() for c in raw.columns])
    fields = [c for c in frame.columns if c not in keys]
    present = lambda names: [blank_to_null(F.col(f"`{n}`")) for n in names if n in fields]

    def pick(names: list[str], default: str | None) -> Column:
        return F.coalesce(*present(names), F.lit(default).cast("string"))

    typed = F.upper(strip(pick(["type"], "")))
    amount = parse_amount(pick(["amount"], "0"))
    date_str = strip(pick(fv.DATE_COLUMNS, ""))
    staged = frame.filter(F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in fields])) > 0).select(
        *keys, typed.alias("_type"), amount.alias("_amount"), date_str.alias("date_str"),
        strip(pick(fv.NARRATION_COLUMNS, "")).alias("description"),
        parse_amount(pick(fv.DEBIT_COLUMNS, "0")).alias("_debit"),
        parse_amount(pick(fv.CREDIT_COLUMNS, "0")).alias("_credit"),
        parse_amount(pick(fv.BALANCE_COLUMNS, "0")).alias("balance"),
        pick(fv.TXN_ID_COLUMNS, None).alias("txn_id"), pick(["mode"], None).alias("mode"),
    )
    staged = with_ts(staged, "date_str")
    is_debit, is_credit = F.col("_type") == "DEBIT", F.col("_type") == "CREDIT"
    return staged.filter(F.col("ts").isNotNull() | ((is_debit | is_credit) & (F.col("_amount") > 0))).select(
        *keys, "ts", "date_str", "description",
        F.when(is_debit, F.col("_amount")).when(is_credit, 0.0).otherwise(F.col("_debit")).alias("debit"),
        F.when(is_credit, F.col("_amount")).when(is_debit, 0.0).otherwise(F.col("_credit")).alias("credit"),
        "balance", "txn_id", "mode", F.col("ts").isNull().alias("date_missing"))


def applicant_of(path: Column) -> Column:
    """Applicant number a file name starts with."""
    return F.regexp_extract(path, r"(\d+)[^/]*$", 1).try_cast("bigint")


def read_statements(spark: SparkSession, *paths: str, multi_line: bool = False) -> DataFrame:
    """Statement CSV files; the applicant comes from the file name, the order from the file.

    Spark gives all files of one path the header of the first, so each path stands for
    one header style (one bank); further styles are further paths, and come after it.
    ``multi_line`` allows line breaks in quoted fields, at the cost of a task per file.
    """
    def one(path: str) -> DataFrame:
        raw = spark.read.option("header", True).option("multiLine", multi_line).csv(path)
        return parse_statements(raw.withColumns({
            "applicant_id": applicant_of(F.col("_metadata.file_name")), "seq": F.lit(0).cast("bigint")}))

    # A union keeps the order of its parts' partitions, so one numbering spans all paths.
    every = reduce(DataFrame.unionByName, [one(p) for p in paths])
    return every.withColumn("seq", F.monotonically_increasing_id())


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, names): the column names of every CSV file under a path, trimmed and lowercased."""
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Rows of a file's first block are numbered in its order; its first line has the least number.
    first = lines.filter("block = 0").withColumn("no", F.monotonically_increasing_id()).groupBy("file").agg(
        F.min_by("value", "no").alias("line"))
    cells = F.from_csv(F.regexp_replace("line", "^\ufeff|\r$", ""), F.lit(", ".join(f"c{i} STRING" for i in range(MOST_COLUMNS))))
    names = first.select("file", cells.alias("cells")).select("file", F.array(*[F.col(f"cells.c{i}") for i in range(MOST_COLUMNS)]).alias("cells"))
    return names.select("file", F.transform("cells", lambda c: F.lower(strip(c))).alias("names"))


def read_statement_folder(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Statement CSV files of any mix of header styles under one path.

    Each file's first line says where its columns are; it is read once per file and meets the
    rows by file. The applicant is the ``applicant_id=`` folder, if there is one, else the number
    the file name starts with. Up to ``MOST_COLUMNS`` columns of a file are read. ``seq`` rises
    with the order of rows in a file.
    """
    known = list(dict.fromkeys([
        "type", "amount", "mode", *fv.DATE_COLUMNS, *fv.NARRATION_COLUMNS, *fv.DEBIT_COLUMNS, *fv.CREDIT_COLUMNS, *fv.BALANCE_COLUMNS,
        *fv.TXN_ID_COLUMNS]))
    # Where each known column stands is looked up once per file, not per row.
    headers = settle(header_lines(spark, path).select("file", F.array(*[F.array_position("names", name).cast("int") for name in known]).alias("at")))
    if headers.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        headers = F.broadcast(headers)
    # One column more than is read: the parser then picks cells by position, and rows of any length are no failures to it.
    rows = spark.read.schema(", ".join(f"c{i} STRING" for i in range(MOST_COLUMNS + 1))).option("multiLine", multi_line).option(
        "recursiveFileLookup", True).csv(path)
    folder = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"/applicant_id=(\d+)/", 1), F.lit("")).try_cast("bigint")
    placed = rows.select(
        F.coalesce(folder, applicant_of(F.col("_metadata.file_name"))).alias("applicant_id"),
        F.monotonically_increasing_id().alias("seq"), F.col("_metadata.file_path").alias("file"),
        F.array(*[f"c{i}" for i in range(MOST_COLUMNS)]).alias("cells")).join(headers, "file")
    cell = lambda n, name: F.get("cells", F.get("at", F.lit(n)) - 1).alias(name)
    # A header line is no transaction: its date is no date, and its type none of the two.
    # As a generated row, a cell is looked up once, not wherever parsing names it.
    cells = F.inline(F.array(F.struct(*[cell(n, name) for n, name in enumerate(known)])))
    return parse_statements(placed.select("applicant_id", "seq", cells))


def explode_statements(statements: DataFrame) -> DataFrame:
    """Nested statements, one row per transaction, in their given order."""
    rows = statements.select(
        "applicant_id", "opening_balance", F.posexplode("transactions").alias("seq", "t")
    ).withColumn("date_str", F.col("t.date"))
    return with_ts(rows, "date_str").select(
        "applicant_id", "opening_balance", F.col("seq").cast("bigint").alias("seq"),
        "ts", "date_str", F.col("t.description").alias("description"),
        F.coalesce("t.debit", F.lit(0.0)).alias("debit"), F.coalesce("t.credit", F.lit(0.0)).alias("credit"),
        F.coalesce("t.balance", F.lit(0.0)).alias("balance"), F.coalesce("t.failed", F.lit(False)).alias("failed"))


def read_statement_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(STATEMENT_JSON).option("multiLine", True).json(path)
    return explode_statements(raw.withColumn("applicant_id", F.coalesce(
        "applicant_id", applicant_of(F.col("_metadata.file_name")))))


def statement_lines(txns: DataFrame) -> DataFrame:
    """Transactions as the columns of a statement file; zero amounts are blank."""
    amount = lambda name: F.when(F.col(name) != 0, F.col(name))
    return txns.select(
        "applicant_id", "seq", F.date_format("ts", "dd-MM-yyyy").alias("Date"), F.col("description").alias("Description"),
        amount("debit").alias("Debit"), amount("credit").alias("Credit"), F.col("balance").alias("Balance"))


def write_statements(txns: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One folder per applicant, each file in statement order.

    Rows meet by applicant and block of a million rows: few files per applicant, and a
    hot one fills many.
    """
    lines = statement_lines(txns).repartition("applicant_id", F.floor(F.col("seq") / 1_000_000)).sortWithinPartitions(
        "applicant_id", "seq")
    writer = lines.write.mode(mode).partitionBy("applicant_id")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown statement format {fmt}")
