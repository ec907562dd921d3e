"""First table of an HTML export (a spreadsheet file that is HTML inside).

An HTML document has to be read as one text, so a file is one task; the work is
parallel over files, and large extracts should be landed as CSV or Parquet. Tables
within cells, spanning cells and character references need a parser, which is the
one step of the engine that runs in Python.
"""

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from html import unescape
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from faultledger.functions.text import strip

# A number with separators of thousands, which this format drops.
_GROUPED_NUMBER = r"^[+-]?(?:\d+,)+\d*(?:\.\d*)?(?:[eE]-?\d+)?$"
# Widest colspan that is spread; the limit that HTML itself sets. A rowspan ends with the table.
_WIDEST = 1000
_SCHEMA = "file string, row bigint, cells array<string>"
_HEADS = "file string, names array<string>, width int"
# Rows of nothing but cells with plain text, which need no parser.
_PLAIN_ROWS = re.compile(r"(?:<tr>(?:<td>[^<]*+</td>)++</tr>\s*+)++")


class _HeadIsKnown(Exception):
    """The first row of data below a header has been read."""


class _Tables(HTMLParser):
    """The rows of all tables that are not in a cell: (is_header, group, [(tag, text, columns, rows)]).

    Of rows that need no parser the cells are texts. With ``head_only`` reading ends by
    ``_HeadIsKnown`` where the first row of data comes after a header.
    """

    def __init__(self, head_only: bool = False):
        super().__init__(convert_charrefs=True)
        self.head_only = head_only
        self.tables, self.depth, self.hidden = [], 0, 0
        self.row = self.cell = None
        self.in_head = False
        self.group = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1:
            if tag in ("tr", "thead", "tbody", "tfoot"):
                self._end_row()
                self.in_head = tag == "thead" or (tag == "tr" and self.in_head)
                if tag == "tr":
                    self.row = []
                else:
                    self.group += 1
            elif tag in ("td", "th"):
                self._end_cell()
                if self.row is None:
                    self.row = []
                spans = dict(attrs)
                self.cell = [tag, [], min(max(_span(spans.get("colspan")), 1), _WIDEST), _span(spans.get("rowspan"))]
        elif self.depth > 1 and self.cell and tag in ("td", "th"):
            self.cell[1].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(self.hidden - 1, 0)
        elif tag == "table" and self.depth:
            if self.depth == 1:
                self._end_row()
                self.in_head = False
            self.depth -= 1
        elif self.depth == 1:
            if tag in ("tr", "thead", "tbody", "tfoot"):
                self._end_row()
                self.in_head = self.in_head and tag == "tr"
                self.group += tag != "tr"
            elif tag in ("td", "th"):
                self._end_cell()

    def handle_data(self, data):
        if self.cell and not self.hidden:
            self.cell[1].append(data)

    def _end_cell(self):
        if self.cell:
            tag, parts, columns, rows = self.cell
            self.row.append((tag, "".join(parts), columns, rows))
            self.cell = None

    def _end_row(self):
        self._end_cell()
        if self.row:
            all_headings = all(cell[0] == "th" for cell in self.row)
            self._add_row(self.in_head or all_headings, self.row)
        self.row = None

    def _add_row(self, is_header, row):
        table = self.tables[-1]
        table.append((is_header, self.group, row))
        if self.head_only and not is_header and table[0][0] and not any(self.tables[:-1]):
            raise _HeadIsKnown

    def feed_all(self, html: str) -> None:
        """``feed``, but runs of plain rows are split by their tags wherever the parser would read them as rows."""
        at = 0
        for run in _PLAIN_ROWS.finditer(html):
            self.feed(html[at : run.start()])
            at = run.start()
            # nothing is left over that these tags may belong to
            if self.rawdata == "" and self.depth == 1 and not self.hidden and self.cdata_elem is None:
                self._end_row()
                for line in run[0].split("</tr>")[:-1]:
                    cells = line[line.index("<tr>") + len("<tr><td>") : -len("</td>")].split("</td><td>")
                    self._add_row(self.in_head, [unescape(cell) if "&" in cell else cell for cell in cells])
                at = run.end()
        self.feed(html[at:])
        self.close()
        self._end_row() if self.tables else None


def _span(text: str | None) -> int:
    # other digits than these are digits to Python, but no number in HTML
    return int(text) if text and re.fullmatch(r"\s*[0-9]+\s*", text) else 1


def first_table(html: str, head_only: bool = False) -> list[tuple]:
    """The rows of the first table that has any; with ``head_only`` up to the first row of data, if there is a header."""
    parser = _Tables(head_only)
    try:
        parser.feed_all(html)
    except _HeadIsKnown:
        pass
    return next((t for t in parser.tables if t), [])


def parse_first_table(html: str, head_only: bool = False) -> list[tuple[bool, list[str]]]:
    """(is_header, cells) of the first table with a row; spanning cells stand in every place they cover.

    A rowspan of zero covers the rest of its row group.
    """
    table = first_table(html, head_only)
    out, open_below = [], {}
    for is_header, group, row in table:
        if isinstance(row[0], str):
            if not any(left for _, left, _ in open_below.values()):
                open_below.clear()
                out.append((is_header, row))
                continue
            row = [("td", text, 1, 1) for text in row]
        cells = []

        def fill():
            while len(cells) in open_below:
                text, left, only = open_below[len(cells)]
                if not left or only not in (None, group):
                    return
                open_below[len(cells)] = (text, left - 1, only)
                cells.append(text)

        for _, text, columns, rows in row:
            fill()
            for _ in range(columns):
                open_below[len(cells)] = (text, rows - 1, None) if rows else (text, len(table), group)
                cells.append(text)
        fill()
        out.append((is_header, cells))
    return out


def _ungrouped(text: Column) -> Column:
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(text.rlike(_GROUPED_NUMBER), plain).otherwise(text)


def _one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[\r\n]+|\s{2,}", " "))


def first_data_row(rows: Sequence[tuple[bool, list[str]]]) -> int:
    return next((at for at, (is_header, _) in enumerate(rows) if not is_header), len(rows))


def _pages(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select("_metadata.file_path", "value")


def _texts() -> Column:
    # Two steps, so that the text of a cell is made once and then named thrice.
    return F.transform(F.transform("cells", _one_line), _ungrouped)


def table_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, row, cells): the rows below the header of the first table of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, html in zip(*(column.to_pylist() for column in batch.columns)):
                rows = parse_first_table(html)
                data = first_data_row(rows)
                yield pa.record_batch(
                    [
                        pa.array([file] * (len(rows) - data), pa.string()),
                        pa.array(range(data, len(rows)), pa.int64()),
                        pa.array([cells for _, cells in rows[data:]], pa.list_(pa.string())),
                    ],
                    names=["file", "row", "cells"],
                )

    return _pages(spark, paths).mapInArrow(run, _SCHEMA).withColumn("cells", _texts())


def table_heads(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, names, width): the header of each file with a table, or its widest row where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file, html in zip(*(column.to_pylist() for column in batch.columns)):
                rows = parse_first_table(html, head_only=True)
                data = first_data_row(rows)
                if data:
                    found.append((file, rows[data - 1][1], None))
                elif rows:
                    found.append((file, None, max(len(cells) for _, cells in rows)))
            types = (pa.string(), pa.list_(pa.string()), pa.int32())
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(types)]
            yield pa.record_batch(columns, names=["file", "names", "width"])

    heads = _pages(spark, paths).mapInArrow(run, _HEADS).withColumnRenamed("names", "cells")
    return heads.select("file", _texts().alias("names"), "width")


def html_frames(spark: SparkSession, path: str) -> tuple[DataFrame, ...]:
    """All columns as text; a frame for the files of each header, which names the columns.

    Of several header rows at the top the last is the header; a file without any has
    the columns 0, 1, ... up to its widest row. A row with text beyond the header
    fails when it is read: its cells can't be told apart. Headers are read by a pass of
    their own that ends with them; the rows are parsed once, where they are read.
    """
    # imported here, as the readers of all formats import this one
    from faultledger.sources.extracts import exact

    heads = table_heads(spark, exact(path)).groupBy("names", "width").agg(
        F.sort_array(F.collect_list("file")).alias("files")
    )
    # one row per header; Spark's listing of the folder has the names of the files too
    known = sorted(heads.collect(), key=lambda r: r["files"][0])
    if not known:
        raise ValueError(f"no table in {path}")
    if len(known) == 1:
        return (_named(table_rows(spark, exact(path)), path, known[0]),)
    return tuple(
        _named(table_rows(spark, [exact(unquote(file)) for file in one["files"]]), path, one) for one in known
    )


def _named(rows: DataFrame, path: str, head: Row) -> DataFrame:
    from faultledger.sources.extracts import POSITION, unique_names

    names = unique_names(head["names"]) if head["names"] is not None else [str(i) for i in range(head["width"])]
    surplus = F.slice("cells", len(names) + 1, F.greatest(F.size("cells") - len(names), F.lit(0)))
    message = f"a row of {path} has more cells than its header"
    fits = F.assert_true(~F.exists(surplus, lambda cell: cell != ""), F.lit(message)).isNull()
    position = F.struct(F.col("file").alias("part"), F.array("row").alias("at")).alias(POSITION)
    return rows.where(fits).select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)], position)


def read_html_table(spark: SparkSession, path: str) -> DataFrame:
    """``html_frames`` as one frame, by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), html_frames(spark, path))
