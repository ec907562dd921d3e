"""Read an extract, all columns as text, one ``spark.read`` per source and header.

An extract is a file or a folder of part files, each with a header of its own. Every
row carries its position, so that "the first row of the file" means the same under
any splitting, and rows that do not fit are marked, not lost.
"""

import logging
import re
from collections.abc import Collection, Mapping
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger.fixed_values import NA_TOKENS
from faultledger.sources.contracts import Contract
from faultledger.sources.html_table import html_frames

log = logging.getLogger(__name__)


class ExtractError(RuntimeError):
    """An extract of one source could not be read."""


@dataclass(frozen=True)
class Extract:
    """A raw frame and the text or column that names the file of each row.

    ``more`` are the frames of part files that have other headers.
    """

    frame: DataFrame
    file: str | Column
    more: tuple[DataFrame, ...] = ()

    @property
    def frames(self) -> tuple[DataFrame, ...]:
        return (self.frame, *self.more)


_NA_LIST = ", ".join(f"'{token}'" for token in NA_TOKENS)


# Column with the position of a row, as ``schemas.ROW_ORDER`` has it.
POSITION = "_position"
# Why a row does not fit, and the row as it stands in its file; null for rows that do.
REJECT_REASON, REJECT_LINE = "_reject_reason", "_reject_line"
_OWN = (POSITION, REJECT_REASON, REJECT_LINE)
CORRUPT = "_corrupt_line"
TOO_WIDE, NOT_JSON = "more cells than the header", "not a JSON record"
# How many 64-bit hashes there are.
_HASHES = Decimal(2**64)
# One cell of a line, with the comma before it.
_CELL = r',(?:"(?:[^"]++|"")*+"[^,]*+|[^,]*+)'


def _name(header: str) -> str:
    return "`" + header.replace("`", "``") + "`"


def quoted(header: str) -> Column:
    """A column by its exact header text, whatever characters it has."""
    return F.col(_name(header))


def null_tokens(frame: DataFrame) -> DataFrame:
    """Every column as text, with the NA tokens as nulls."""
    # As SQL text, since a call for each token of each column takes a second per run.
    return frame.selectExpr(
        *[
            f"if(string({quoted_name}) in ({_NA_LIST}), null, string({quoted_name})) as {quoted_name}"
            if name not in _OWN
            else name
            for name, quoted_name in ((c, _name(c)) for c in frame.columns)
        ]
    )


def drop_noise_rows(frame: DataFrame, contract: Contract) -> DataFrame:
    """Drop rows without a row id, if the extract has such a column."""
    if contract.row_id in frame.columns:
        return frame.where(quoted(contract.row_id).isNotNull() | rejected(frame))
    return frame


def rejected(frame: DataFrame) -> Column:
    """Whether a row of a raw frame does not fit."""
    return F.col(REJECT_LINE).isNotNull() if REJECT_LINE in frame.columns else F.lit(False)


def marked(rows: DataFrame, reason: str, line: Column) -> DataFrame:
    """``rows`` with the reason and the text of those whose ``line`` is not null."""
    found = rows.withColumn(REJECT_LINE, line)
    return found.withColumn(REJECT_REASON, F.when(F.col(REJECT_LINE).isNotNull(), F.lit(reason)))


def tagged(frame: DataFrame, contract: Contract) -> DataFrame:
    return frame.withColumn("_plant_tag", F.lit(contract.tag)) if contract.tag else frame


def prepare(frame: DataFrame, contract: Contract) -> DataFrame:
    """What every reader does after the scan."""
    return tagged(drop_noise_rows(null_tokens(frame), contract), contract)


def exact(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def position(at: Column) -> Column:
    """Position of a row of a file scan, but for the order within a split, which the mapping adds."""
    return F.struct(F.col("_metadata.file_path").alias("part"), F.array(at).alias("at")).alias(POSITION)


def split_start() -> Column:
    return F.col("_metadata.file_block_start")


def unique_names(headers: Collection[str | None], wanted: Collection[str] = ()) -> list[str]:
    """Column names of a header row: the second "a" becomes "a.1", an empty cell "Unnamed: 2".

    Names that are equal up to case can't stand side by side in a frame; of these
    the one that is ``wanted`` keeps its name, else the first.
    """
    names: list[str] = []
    for at, header in enumerate(headers):
        name, n = header or f"Unnamed: {at}", 0
        while (f"{name}.{n}" if n else name) in names:
            n += 1
        names.append(f"{name}.{n}" if n else name)
    taken = {name.lower(): name for name in reversed(names)} | {n.lower(): n for n in names if n in wanted}
    return [name if taken[name.lower()] == name else f"{name} ({at})" for at, name in enumerate(names)]


def _odd_quotes() -> Column:
    return (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a line ends within quotes, by a parallel pass over the lines."""
    return not spark.read.text(exact(path)).where(_odd_quotes()).isEmpty()


@dataclass(frozen=True)
class _Part:
    file: str
    # Equal for files whose first line is equal.
    head: str
    quoted_breaks: bool


def part_heads(spark: SparkSession, path: str) -> list[_Part]:
    """A row per file with lines: what its first line is, and whether a line ends within quotes.

    One parallel pass over the lines, with numbers only in the aggregate: the
    smallest place of a line within its split, with the hash of the line behind it.
    The first split of a file lies in one partition, so places in it can be compared.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    behind = F.pmod(F.xxhash64("value").cast("decimal(38,0)"), F.lit(_HASHES).cast("decimal(38,0)"))
    packed = (place.cast("decimal(12,0)") * F.lit(_HASHES)).cast("decimal(38,0)") + behind
    first = (F.col("_metadata.file_block_start") == 0) & (F.length(F.btrim("value")) > 0)
    lines = spark.read.text(exact(path)).select(
        F.col("_metadata.file_path").alias("file"), F.when(first, packed.cast("decimal(38,0)")).alias("first"), _odd_quotes().alias("odd")
    )
    found = lines.groupBy("file").agg(F.min("first").alias("first"), F.max("odd").alias("odd")).where(F.col("first").isNotNull())
    head = F.pmod("first", F.lit(_HASHES).cast("decimal(38,0)")).cast("string")
    rows = found.select("file", head.alias("head"), "odd").collect()
    return sorted((_Part(unquote(r["file"]), r["head"], r["odd"]) for r in rows), key=lambda part: part.file)


def csv_frames(
    spark: SparkSession, path: str, multi_line: bool | None = None, wanted: Collection[str] = ()
) -> tuple[DataFrame, ...]:
    """UTF-8 with or without a byte order mark, header row, doubled quotes; a frame per header.

    Part files with equal first lines are read together. Quoted line breaks make a
    file one task; unless ``multi_line`` says whether there are any, the files are
    looked through. A row with text beyond the header is marked with its line, since
    its cells can't be told apart; empty cells beyond it say nothing and are left out.
    """
    # the paths to read at once, and the files behind them
    groups: list[tuple[list[str], list[str]]] = [([path], [path])]
    if len(spark.read.text(exact(path)).inputFiles()) > 1:
        parts = part_heads(spark, path)
        if not parts:
            raise ValueError(f"no header row in {path}")
        by_head: dict[str, list[str]] = {}
        for part in parts:
            by_head.setdefault(part.head, []).append(part.file)
        whole = len(by_head) == 1
        groups = [([path] if whole else files, files) for files in by_head.values()]
        if multi_line is None:
            multi_line = any(part.quoted_breaks for part in parts)
    elif multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    frames, waiting = [], groups
    while waiting:
        paths, files = waiting.pop(0)
        first = _csv_reader(spark, multi_line).csv(exact(files[0]), header=False).first()
        if first is None:
            raise ValueError(f"no header row in {files[0]}")
        if len(files) > 1 and any("\n" in (cell or "") for cell in first):
            # the header goes on after its first line, where these files may differ
            waiting = [([file], [file]) for file in files] + waiting
            continue
        names = unique_names([str(cell) if cell is not None else None for cell in first], wanted)
        frames.append(_csv_frame(_csv_reader(spark, multi_line), paths, names))
    return tuple(frames)


def _csv_reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    """A reader of its own for every read, since it keeps the schema and options that it is given."""
    return spark.read.options(multiLine=multi_line, quote='"', escape='"')


def _csv_frame(reader: DataFrameReader, files: list[str], names: list[str]) -> DataFrame:
    fields = [T.StructField(name, T.StringType()) for name in [*names, CORRUPT]]
    rows = reader.options(columnNameOfCorruptRecord=CORRUPT, mode="PERMISSIVE").csv(
        [exact(file) for file in files], header=True, schema=T.StructType(fields)
    )
    return marked(rows.select("*", position(split_start())), TOO_WIDE, beyond(names)).drop(CORRUPT)


def beyond(names: list[str]) -> Column:
    """The line of a record that has text after its cells with ``names``; Spark gives the lines of shorter ones too."""
    rest = F.regexp_replace(F.concat(F.lit(","), CORRUPT), f"^(?:{_CELL}){{0,{len(names)}}}+", "")
    return F.when(_with_all(names) & rest.rlike(r'[^,\s"]'), F.col(CORRUPT))


def _with_all(names: Collection[str]) -> Column:
    """Whether a record is marked by Spark, asked so that it is parsed whole, whatever columns a query reads."""
    any_cell = F.coalesce(*(quoted(name).cast("string") for name in names), F.col(CORRUPT))
    return F.col(CORRUPT).isNotNull() & any_cell.isNotNull()


def stacked(frames: Collection[DataFrame]) -> DataFrame:
    """The rows that fit, of all frames, by name."""
    fitting = [frame.where(~rejected(frame)).drop(REJECT_REASON, REJECT_LINE) for frame in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fitting)


def read_csv(
    spark: SparkSession, path: str, multi_line: bool | None = None, wanted: Collection[str] = ()
) -> DataFrame:
    """``csv_frames`` as one frame of the rows that fit."""
    return stacked(csv_frames(spark, path, multi_line, wanted))


def json_frame(spark: SparkSession, path: str) -> DataFrame:
    """Records by name, whatever names a file has; lines that are no record are marked."""
    rows = spark.read.options(primitivesAsString=True, columnNameOfCorruptRecord=CORRUPT).json(exact(path))
    placed = rows.select("*", position(split_start()))
    if CORRUPT not in rows.columns:
        return placed
    names = [name for name in rows.columns if name != CORRUPT]
    return marked(placed, NOT_JSON, F.when(_with_all(names), F.col(CORRUPT))).drop(CORRUPT)


def scan(
    spark: SparkSession,
    path: str,
    csv_multi_line: bool | None = None,
    wanted: Collection[str] = (),
) -> tuple[DataFrame, ...]:
    """Read by the suffix of the path; a frame for every set of columns that has to be read by itself."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return csv_frames(spark, path, csv_multi_line, wanted)
    if suffix in ("xls", "html", "htm"):
        return html_frames(spark, path)
    if suffix == "json":
        return (json_frame(spark, path),)
    if suffix == "parquet":
        rows = spark.read.option("mergeSchema", True).parquet(exact(path))
        return (rows.select("*", position(F.col("_metadata.row_index"))),)
    raise ValueError(f"unsupported file type: {suffix}")


def read_extract(
    spark: SparkSession, path: str, contract: Contract, csv_multi_line: bool | None = None
) -> Extract:
    try:
        frames = scan(spark, path, csv_multi_line, contract.headers())
    except Exception as error:  # a bad file shows in many ways, all mean the same here
        raise ExtractError(f"{contract.key}: cannot read {path}: {error}") from error
    first, *more = (prepare(frame, contract) for frame in frames)
    return Extract(first, path, tuple(more))


def read_extracts(
    spark: SparkSession,
    files: Mapping[str, str | None],
    contracts: Mapping[str, Contract],
    csv_multi_line: bool | None = None,
) -> tuple[dict[str, Extract], dict[str, str]]:
    """(extracts, failures): one bad source does not stop the others."""
    extracts, failures = {}, {}
    for key, path in files.items():
        if not path or key not in contracts:
            continue
        try:
            extracts[key] = read_extract(spark, path, contracts[key], csv_multi_line)
        except ExtractError as error:
            log.error("%s", error)
            failures[key] = str(error)
    return extracts, failures
