"""One large CSV file read by many tasks, although cells may span lines.

Spark cuts a text file into byte ranges and hands each range its lines. Whether a line starts
inside a quoted cell depends on all quotes before it, so the parity of quotes is a prefix sum:
every range reports the parity of its own quotes, a sum over the ranges of a file (one row per
range) gives the parity at the start of each, and a range then finds its records by itself, in
file order. Records that lie inside one range never leave it. Only what a range border cuts, at
most one piece at each end of a range, is put together by a small grouping.

The files follow RFC 4180: a cell with a quote, a comma or a line break is quoted, a quote in it
is doubled. Lines end in ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import BOM, NULL_MARK, select_present

WHOLE, TAIL, HEAD, TITLE = 0, 1, 2, 3  # a record; the end of an earlier one; the start of one that goes on; the header
_OUT = "file string, start long, kind int, record string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines come in file order, each with its range and the parity at the range's start.

    Per range: an optional tail, whole records, an optional head. A range without a record
    border gives a tail alone.
    """
    place, odd, held, begun, titled = None, 0, [], False, False
    file, start, kind, record = [], [], [], []

    def put(what: int, text: str) -> None:
        file.append(place[0])
        start.append(place[1])
        kind.append(what)
        record.append(text)

    def close() -> None:
        """End of a range: what is held goes on in the next one."""
        if held:
            put(HEAD if begun else TAIL, "\n".join(held))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(file, pa.string()), pa.array(start, pa.int64()), pa.array(kind, pa.int32()), pa.array(record, pa.string())],
            names=["file", "start", "kind", "record"],
        )
        for x in (file, start, kind, record):
            x.clear()
        return out

    for part in batches:
        quotes = pc.count_substring(part.column("value"), '"').to_numpy(zero_copy_only=False) & 1
        values = part.column("value").to_pylist()
        files, starts = part.column("file").to_pylist(), part.column("start").to_numpy()
        parity = part.column("parity").to_numpy()
        for i, line in enumerate(values):
            here = (files[i], int(starts[i]))
            if here != place:
                if place is not None:
                    close()
                place, odd, held = here, int(parity[i]), []
                begun, titled = not odd, False
            held.append(line)
            odd ^= int(quotes[i])
            if not odd:  # the record ends with this line
                text = "\n".join(held)
                titled = titled or place[1] > 0
                if titled or text.strip() == "":
                    put(WHOLE if begun else TAIL, text)
                else:  # the first record of a file
                    put(TITLE, text)
                    titled = True
                held, begun = [], True
        if file:
            yield flush()
    if place is not None:
        close()
    if file:
        yield flush()


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, record): the text of every CSV record below ``path`` without the header of each file.

    ``start`` is the range that holds the record's first line.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2
    ranges = lines.groupBy("file", "start").agg((F.sum(odd) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parity = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("parity")
    # a broadcast keeps the lines where they are and in order; one row per range is small
    at = F.broadcast(ranges.select("file", "start", parity))
    pieces = lines.join(at, ["file", "start"]).select("value", "file", "start", "parity").mapInArrow(_records, _OUT)
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "start", "record")
    cut = pieces.filter(F.col("kind").isin(TAIL, HEAD))
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("number", F.sum((F.col("kind") == HEAD).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    joined = cut.groupBy("file", "number").agg(parts.alias("parts"))
    joined = joined.select("file", F.col("parts")[0]["start"].alias("start"), F.array_join(F.col("parts.record"), "\n").alias("record"))
    return whole.unionByName(joined)


def read_csv_split(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, nulls: bool = False
) -> DataFrame:
    """:func:`.tables.read_csv` for files of any size: all strings, many tasks a file.

    Every file has the same header line, without a line break in it. A record with another
    number of cells fails the read.
    """
    header = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path).columns
    names = [c.removeprefix(BOM) for c in header]
    rows = split_records(spark, path).select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")
    options = {"quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "mode": "FAILFAST", "nullValue": NULL_MARK, "emptyValue": "", "multiLine": "true", "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    cells = rows.select(F.from_csv("record", ddl, options).alias("__r")).select("__r.*")
    cells = cells if nulls else cells.fillna("")
    return cells if columns is None else select_present(cells, columns)
