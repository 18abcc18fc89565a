"""A data source writer whose files have the names that other readers expect, seen all together or not at all.

A row's first column names its file; the others are the file's columns (form ``csv``), or the one other is a piece of
its text, written as it stands (form ``text``). Tasks write below a hidden
folder of the job, and the commit renames what the tasks that succeeded have written: an aborted job, and
an attempt that is lost or comes second, leave nothing that can be seen. Files ending in ``.gz`` are
gzipped. Dates are written as ``2024-01-31``, doubles in full, NULL as nothing. Rows of a file must come
together within one task; two tasks with one name are refused before any file is put in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as pacsv
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..shared import ensured


@dataclass
class Written(WriterCommitMessage):
    """The folder of one attempt, and the names of its files."""

    folder: str
    names: list[str]


class NamedFiles(DataSource):
    """Options ``path``: the folder (a URI), and ``form``: ``csv`` or ``text``. Overwriting replaces the folder's files, appending those of the same names."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> _NamedWriter:
        return _NamedWriter(self.options["path"], overwrite, self.options.get("form", "csv"))


class _NamedWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool, form: str = "csv") -> None:
        self.uri, self.overwrite, self.form = uri, overwrite, form
        self.job = f"_job-{uuid.uuid4().hex}"

    def _at(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = self._at()
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        names: dict[str, None] = {}
        last = out = sink = None
        try:
            for b in batches:
                keys, rows = b.column(0), b.drop_columns([b.schema.names[0]])
                ends = pc.run_end_encode(keys).run_ends.to_pylist() if b.num_rows else []
                for low, high in zip([0, *ends], ends):
                    name = keys[low].as_py()
                    if out is None or name != last:
                        if not _fit(name) or name in names:
                            raise ValueError(f"{name!r} is no file's name, or its rows don't come together")
                        out = _closed(out, sink)
                        sink = fs.open_output_stream(f"{folder}/{name}", compression="gzip" if name.endswith(".gz") else None)
                        out = _Text(sink) if self.form == "text" else _table(sink, rows.schema)
                        names[name], last = None, name
                    out.write_batch(rows.slice(low, high - low))
        finally:
            _closed(out, sink)
        return Written(folder, list(names))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._at()
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self._clear()
            raise ValueError("rows of one file came from several tasks: repartition by its name")
        for m in done:
            for n in m.names:
                fs.move(f"{m.folder}/{n}", f"{root}/{n}")
        if self.overwrite:
            kept = set(names)
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.type == pafs.FileType.File and f.base_name not in kept:
                    fs.delete_file(f.path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = self._at()
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


def _fit(name: str | None) -> bool:
    return bool(name) and "/" not in name and not name.startswith(("_", "."))


class _Text:
    """Texts as they stand, NULL as nothing."""

    def __init__(self, sink) -> None:
        self.sink = sink

    def write_batch(self, rows: pa.RecordBatch) -> None:
        for text in rows.column(0):
            self.sink.write((text.as_py() or "").encode())

    def close(self) -> None:
        pass


def _table(sink, schema: pa.Schema) -> pacsv.CSVWriter:
    sink.write((",".join(schema.names) + "\n").encode())
    return pacsv.CSVWriter(sink, schema, write_options=pacsv.WriteOptions(include_header=False, quoting_style="needed"))


def _closed(out, sink) -> None:
    if out is not None:
        out.close()
    if sink is not None:
        sink.close()


def write_named(df: DataFrame, path: str, order: list[str], mode: str = "overwrite", form: str = "csv") -> None:
    """``df(file, ...)`` as one file for each name, its rows in ``order``; NULL names are an error.

    A file is one stream of one task, in memory a batch at a time, as a single file asks for.
    """
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    name = df.columns[0]
    df.repartition(name).sortWithinPartitions(name, *order).write.format("named_files").mode(mode).option("path", ensured(spark, path)).option("form", form).save()
