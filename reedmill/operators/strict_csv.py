"""Problem 5: records that do not parse are set apart with the reason, all others are loaded.

Method: records are assembled from physical lines by counting quotes, each goes through Python's strict ``csv``
reader inside the partition, structural exceptions are caught there, and only then the typed fields are made.

Defined results: a null or empty raw record has too few columns; a record that holds more than one (a line break
outside quotes) has a wrong number of columns; blanks around id and content do not count.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("article_id", "title", "description", "content", "category")
LARGEST = 9223372036854775807
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_DIGITS = re.compile(r"[0-9]+")


def assemble(lines: Iterable[str]) -> Iterator[str]:
    """Records from physical lines: a record goes on while its quotes are odd in number.  Ends without line break."""
    held: list[str] = []
    open_quote = False
    for line in lines:
        held.append(line)
        open_quote ^= line.count('"') % 2 == 1
        if not open_quote:
            yield re.sub(r"\r?\n\Z|\r\Z", "", "".join(held))
            held = []
    if held:
        yield re.sub(r"\r?\n\Z|\r\Z", "", "".join(held))


def as_quoted(record: str, fields: list[str]) -> bool:
    """Whether each field with a quote in the record was quoted as a whole."""
    at = 0
    for f in fields:
        if record.startswith('"', at):
            at += len(f) + f.count('"') + 3
        elif '"' in f:
            return False
        else:
            at += len(f) + 1
    return at == len(record) + 1


def parse(raw: str | None) -> tuple[str | None, list[str]]:
    """The reason of failure, or None and the five fields."""
    if not raw:
        return "column_count", []
    records = list(assemble(_LINE.findall(raw)))
    rows = []
    for record in records:
        try:
            rows.append(next(csv.reader([record], strict=True), []))
        except csv.Error:
            return "quoting", []
        if not as_quoted(record, rows[-1]) and record:
            return "quoting", []
    if len(rows) != 1 or len(rows[0]) != len(FIELDS):
        return "column_count", []
    fields = rows[0]
    number = fields[0].strip()
    value = number.lstrip("0")
    if not _DIGITS.fullmatch(number) or not value or len(value) > 19 or int(value) > LARGEST:
        return "invalid_value", []
    content = fields[3].strip()
    if not content or content.lower() == "nan":
        return "invalid_value", []
    return None, fields


RESULT = "reason string, article_id long, title string, description string, content string, category string"


def read_strict(rows: DataFrame, raw: str = "raw_line", keep: tuple[str, ...] = ("row_id", "split", "file_name", "line_no")) -> DataFrame:
    """The kept columns, and either the reason of failure or the article's typed fields."""
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep) + ", " + RESULT
    last = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            parsed = [parse(x) for x in batch.column(last).to_pylist()]
            good = [f if r is None else None for r, f in parsed]
            out = [batch.column(i) for i in range(last)]
            out.append(pa.array([r for r, _ in parsed], pa.string()))
            out.append(pa.array([int(f[0].strip()) if f else None for f in good], pa.int64()))
            out += [pa.array([f[i] if f else None for f in good], pa.string()) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "reason", *FIELDS])

    return rows.select(*keep, F.col(raw)).mapInArrow(work, schema)


def file_records(spark: SparkSession, path: str, skip_header: bool = True) -> DataFrame:
    """The records of strict CSV files (file_name, line_no of the first line, raw_line), broken ones too.

    A file with quoted line breaks has no place at which it could be split, so that each file is one task's.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = _LINE.findall(text.removeprefix("\ufeff"))
                held, at = [], 1
                for record in assemble(lines):
                    held.append((at, record))
                    at += record.count("\n") + 1
                held = held[1 if skip_header else 0 :]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array([n for n, _ in held], pa.int64()), pa.array([r for _, r in held], pa.string())], names=["file_name", "line_no", "raw_line"])

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return texts.mapInArrow(work, "file_name string, line_no long, raw_line string")


def rejects(rows: DataFrame) -> DataFrame:
    return read_strict(rows, keep=("row_id",)).where("reason is not null").select("row_id", "reason")


def articles(rows: DataFrame) -> DataFrame:
    return read_strict(rows).where("reason is null").drop("reason")
