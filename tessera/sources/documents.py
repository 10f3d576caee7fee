"""Result documents as a Spark data source: each file is parsed item by item into Arrow batches.

A document is a JSON object with a header and a list `items`; a file holds one, or several after each other (JSON lines),
plain or gzip. Whatever its size, a task holds one item and one batch of rows. A condition on the file's name leaves files out.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.results import ITEM

READ = 1 << 18  # characters read at once
BATCH = 1 << 22  # characters of items in a batch
SCHEMA = f"file string, document int, row_idx int, error string, header string, {ITEM}"
_BLANK = re.compile(r"[ \t\r\n]*")


class Broken(ValueError):
    """A file that is not a sequence of JSON objects."""


class Text:
    """A stream of characters of which only what is being parsed is held."""

    def __init__(self, source):
        self.source, self.held, self.at, self.ended = source, "", 0, False
        self.decoder, self.passed = json.JSONDecoder(), 0

    def more(self) -> bool:
        piece = "" if self.ended else self.source.read(READ)
        self.ended = not piece
        self.passed += self.at
        self.held, self.at = self.held[self.at :] + piece, 0
        return not self.ended

    def peek(self) -> str:
        """The next character that is not blank; '' at the end."""
        while True:
            self.at = _BLANK.match(self.held, self.at).end()
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if found not in wanted or not found:
            raise Broken(f"{found or 'the end'} at character {self.passed + self.at}, where {' or '.join(wanted)} is due")
        self.at += 1
        return found

    def value(self):
        """The next JSON value. A value that touches the end of what is held may go on, so more is read before it is believed;
        what is read doubles, so a long value is parsed few times."""
        self.peek()
        want = READ
        while True:
            try:
                value, end = self.decoder.raw_decode(self.held, self.at)
                if end < len(self.held) or self.ended:
                    self.at = end
                    return value
            except ValueError as wrong:
                if self.ended:
                    raise Broken(f"no JSON value at character {self.passed + self.at}: {wrong}") from None
            goal = len(self.held) - self.at + want
            while len(self.held) - self.at < goal and self.more():
                pass
            want *= 2


def parsed(text: Text) -> Iterator[tuple[str, object]]:
    """The events of a file: ('item', value) for each item, ('end', header) when a document is over."""
    while text.peek():
        text.take("{")
        header = {}
        if text.peek() == "}":
            text.take("}")
            yield "end", header
            continue
        while True:
            if text.peek() != '"':
                text.take('"')
            key = text.value()
            text.take(":")
            if key != "items" or text.peek() != "[":
                header[key] = text.value()
            else:
                text.take("[")
                if text.peek() == "]":
                    text.take("]")
                else:
                    while True:
                        yield "item", text.value()
                        if text.take(",", "]") == "]":
                            break
            if text.take(",", "}") == "}":
                break
        yield "end", header


def conformed(value, kind: pa.DataType):
    """A parsed value in the shape of a type; what does not fit is null."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: conformed(value.get(f.name), f.type) for f in kind} if isinstance(value, dict) else None
    if pa.types.is_list(kind):
        return [conformed(v, kind.value_type) for v in value] if isinstance(value, list) else None
    if pa.types.is_string(kind):
        return value if isinstance(value, str) else json.dumps(value)
    if pa.types.is_boolean(kind):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if pa.types.is_floating(kind):
        return float(value)
    return value if isinstance(value, int) and -(1 << (kind.bit_width - 1)) <= value < 1 << (kind.bit_width - 1) else None


def rows_of(source, file: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a file's rows: one an item; at a document's end one with its header; and, if the file breaks, one that says
    where. Rows before the break stay, as they were whole."""
    text = Text(source)
    fields = [f for f in schema if f.name not in ("file", "document", "row_idx", "error", "header")]
    document, place, rows, began = 0, 0, [], 0

    def row(**known):
        return {f.name: None for f in schema} | {"file": file, "document": document} | known

    def batch():
        nonlocal rows, began
        out, rows, began = pa.RecordBatch.from_pylist(rows, schema), [], text.passed + text.at
        return out

    try:
        for kind, value in parsed(text):
            if kind == "item":
                item = value if isinstance(value, dict) else {}
                rows.append(row(row_idx=place, **{f.name: conformed(item.get(f.name), f.type) for f in fields}))
                place += 1
            else:
                rows.append(row(header=json.dumps(value)))
                document, place = document + 1, 0
            if text.passed + text.at - began > BATCH:
                yield batch()
        if not document:
            rows.append(row(error="no document"))
    except (Broken, UnicodeDecodeError, OSError, EOFError) as wrong:
        rows.append(row(error=str(wrong)[:500] or type(wrong).__name__))
    if rows:
        yield batch()


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class DocumentReader(DataSourceReader):
    def __init__(self, schema: T.StructType, files: list[str]):
        self.schema, self.files = schema, files

    def partitions(self):
        return [File(f) for f in self.files] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        import codecs

        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        store, path = pafs.FileSystem.from_uri(partition.path) if re.match(r"\w+:", partition.path) else (pafs.LocalFileSystem(), partition.path)
        schema = to_arrow_schema(self.schema)
        with store.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as stream:
            yield from rows_of(codecs.getreader("utf-8")(stream), partition.path, schema)


class Documents(DataSource):
    """Format `result_documents`; option `files` is a JSON list of paths."""

    @classmethod
    def name(cls) -> str:
        return "result_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DocumentReader(schema, json.loads(self.options["files"]))


def read_items_streamed(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(file, document, row_idx, error, header, item's columns) of all files that a path, folder or glob names on any Hadoop file
    system which Arrow opens too, and whose `file` meets the condition, so the others are not opened. See `rows_of` for
    the rows. No file gives an empty table.

    The condition is a parameter and not pushed by Spark: this version keeps what one use of a frame has pushed into
    a Python source for all later uses of it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark.dataSource.register(Documents)
    files = listed(spark, path)
    if where is not None:
        files = [r.file for r in spark.createDataFrame([(f,) for f in files], "file string").where(where).collect()]
    return spark.read.format("result_documents").option("files", json.dumps(sorted(files))).load()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Files of a path, glob or folder (its own files only), without those that begin with _ or a dot."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for found in store.globStatus(where) or []:
        inner = store.listStatus(found.getPath()) if found.isDirectory() else [found]
        out += [s.getPath().toString() for s in inner if not s.isDirectory() and s.getPath().getName()[0] not in "_."]
    return sorted(out)
