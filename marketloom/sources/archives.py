"""Tables inside archives, unpacked where Spark reads them."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that go on at a time; a member is never unpacked whole.
ROWS = 10_000


def zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], member: str = r"(?i)\.csv$") -> DataFrame:
    """(archive, member, row, columns) of the CSV members of zip archives, all columns as text.

    An archive is read by one task, its members as streams. A byte order mark is dropped, quoted fields may hold commas, doubled quotes
    and line feeds, empty lines are no rows, and columns go by the member's header: a column that it lacks is null, as is one that a short
    row doesn't reach. Members whose name doesn't match, folders and members without a header give no rows; a broken archive is an error.
    """
    wanted, names = re.compile(member), list(columns)

    def rows_of(archive: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as whole:
            for info in whole.infolist():
                if info.is_dir() or not wanted.search(info.filename):
                    continue
                with whole.open(info) as raw, io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline="") as text:
                    table = csv.reader(text)
                    header = next(table, [])
                    places = [header.index(c) if c in header else None for c in names]
                    for at, cells in enumerate((r for r in table if r), 1):
                        yield archive, info.filename, at, *[cells[p] if p is not None and p < len(cells) else None for p in places]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("row", pa.int64()), *[(c, pa.string()) for c in names]])
        held: list[tuple] = []
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for row in rows_of(archive, content):
                    held.append(row)
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    kept = ", ".join(f"`{c}` string" for c in names)
    # archives come one by one, as each can be large
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, f"archive string, member string, row long, {kept}")
