"""File scans: typed CSV, ragged CSV (first n comma fields), lookup files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.functions.text import NA_TOKENS, drop_replacement_chars, first_fields, null_tokens, strip_line_breaks
from shopstat.sources.quoted_csv import records

# Separator and quote characters that never occur in the shop's text files;
# with them the CSV reader hands over whole lines (and drops each file's
# header line).
_NO_SEP = "\u0001"
_NO_QUOTE = "\u0000"


_CSV = {"quote": '"', "escape": '"', "multiLine": "true"}


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, na_tokens: Sequence[str] = NA_TOKENS,
             multi_line: bool = True) -> DataFrame:
    """CSV with a header: the columns of ``schema`` by name in its types (a
    value that doesn't fit is null), and ``_record`` (the text of a row that
    can't be taken as it is) with ``_reason``, both null for good rows.

    A column that the header lacks is an error; others are ignored.  Doubled
    quotes stand for one, blank lines are skipped, missing trailing fields are
    null; a row with more fields than the header, or a value that doesn't fit
    its type, has a reason.  Every column is read as text first so that all
    missing-value tokens (not only one ``nullValue``) become null.  Line breaks
    inside quotes are read in as many tasks as the files have splits
    (``quoted_csv``); ``multi_line=False`` saves its counting scan for files
    known to have none.
    """
    head = spark.read.option("header", True).options(**_CSV).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in head]
    if missing:
        raise ValueError(f"{path}: the header lacks {', '.join(missing)}")
    fields = ", ".join(f"f{i} string" for i in range(len(head) + 1))
    if multi_line:
        texts = records(spark, path)
    else:
        whole = spark.read.option("header", True).option("sep", _NO_SEP).option("quote", _NO_QUOTE).option("escape", _NO_QUOTE)
        texts = whole.schema("record string").csv(path)
    rows = texts.select("record", F.from_csv("record", fields, {**_CSV, "mode": "PERMISSIVE"}).alias("_f"))
    cols, reasons = [], [F.when(F.col(f"_f.f{len(head)}").isNotNull(), F.lit("more fields than the header"))]
    for f in schema.fields:
        text = null_tokens(F.col(f"_f.f{head.index(f.name)}"), list(na_tokens))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.try_to_timestamp(text).cast(f.dataType)
        else:
            value = text.try_cast(f.dataType)
        cols.append(value.alias(f.name))
        reasons.append(F.when(text.isNotNull() & value.isNull(), F.lit(f"{f.name}: not of type {f.dataType.simpleString()}")))
    reason = F.coalesce(*reasons)
    return rows.select(*cols, F.when(reason.isNotNull(), F.col("record")).alias("_record"), reason.alias("_reason"))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType,
                   na_tokens: Sequence[str] = NA_TOKENS, lenient: bool = False, multi_line: bool = True) -> DataFrame:
    """The columns of ``scan_csv``.  Strict reading raises on the first row
    with a reason, lenient reading keeps its fitting values and nulls."""
    rows = scan_csv(spark, path, schema, na_tokens, multi_line)
    if lenient:
        return rows.select(*schema.names)
    message = F.concat(F.lit(f"{path}: "), F.col("_reason"), F.lit(": "), F.substring("_record", 1, 200))
    checked = F.when(F.col("_reason").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return rows.filter(checked).select(*schema.names)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, na_tokens: Sequence[str] = NA_TOKENS,
                     multi_line: bool = True, counts: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: rows without a reason in the types of
    ``schema``, and ``record, reason`` of the others, so that rows in are
    rows accepted and rows rejected.  ``counts`` observes ``rows_in`` and
    ``rows_rejected`` in the pass that reads the accepted rows."""
    rows = scan_csv(spark, path, schema, na_tokens, multi_line)
    rejected = rows.filter("_reason IS NOT NULL").select(F.col("_record").alias("record"), F.col("_reason").alias("reason"))
    if counts is not None:
        rows = rows.observe(counts, F.count(F.lit(1)).alias("rows_in"), F.count("_reason").alias("rows_rejected"))
    return rows.filter("_reason IS NULL").select(*schema.names), rejected


def whole_number(text: Column, data_type: T.DataType) -> Column:
    """Text to an integer type; ``2011.0`` is 2011, ``2011.5`` and other text null."""
    number = text.try_cast("decimal(38,9)")
    return F.coalesce(text.try_cast(data_type), F.when(number == F.floor(number), F.floor(number)).try_cast(data_type))


def read_ragged_csv(spark: SparkSession, path: str, n_fields: int = 10, sep: str = ",",
                    types: dict[str, T.DataType] | None = None,
                    na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Lines cut at every ``sep``, the first ``n_fields`` pieces joined by
    tabs and read as tab-separated fields with quotes, named by the header.

    So a separator inside quotes cuts, but the quote then holds its pieces
    together again (``"Red, Dark"`` is one field ``Red<TAB> Dark``).
    Undecodable bytes are dropped, line-break characters become blanks, blank
    lines are skipped, values are trimmed and missing-value tokens become
    null; missing trailing fields are null.  A quote left open ends with its
    line.  ``types`` casts named columns (lenient: a bad value becomes null).
    """
    raw = (spark.read.option("header", True).option("sep", _NO_SEP).option("quote", _NO_QUOTE)
           .option("escape", _NO_QUOTE).option("ignoreLeadingWhiteSpace", False)
           .option("ignoreTrailingWhiteSpace", False).csv(path))
    header = raw.columns[0]
    names = [drop_replacement_name(n).strip() for n in header.split(sep)[:n_fields]]
    line = strip_line_breaks(drop_replacement_chars(F.col(f"`{header}`")))
    pieces = F.array_join(first_fields(line, n_fields, sep), "\t", "")
    fields = F.from_csv(pieces, ", ".join(f"f{i} string" for i in range(len(names))),
                        {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    parts = raw.select(line.alias("_line"), fields.alias("_f")).filter(F.trim(F.col("_line")) != "")
    cols = []
    for i, name in enumerate(names):
        v = null_tokens(F.trim(F.col(f"_f.f{i}")), list(na_tokens))
        if types and name in types:
            v = whole_number(v, types[name]) if isinstance(types[name], T.IntegralType) else v.try_cast(types[name])
        cols.append(v.alias(name))
    return parts.select(*cols)


def drop_replacement_name(name: str) -> str:
    return name.replace("�", "").replace("\r", " ").replace("\n", " ")


def read_lookup(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Lookup table from CSV (header) or Parquet.  Spreadsheet files are not
    read; export the sheet to CSV first."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
