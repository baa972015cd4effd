"""A sink for the metrics of experiments: runs are appended whole or not at all.

``df.write.format("run_metrics").mode("append").option("path", folder).save()``. Each task writes one file of JSON lines below a
folder whose name begins with ``_``, which Spark's readers pass over; the driver moves the files of the tasks that succeeded
into place once all have, and drops everything if the job fails. A task that is tried again, or runs twice, writes another file, and
only the one it reports counts. Folders may be in any store that Arrow's file systems reach. ``read_metrics`` reads them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "run string, name string, value double, step long, tags map<string,string>"


@dataclass
class _File(WriterCommitMessage):
    path: str | None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, columns: list[str]):
        self.path, self.columns, self.job, self.overwrite = path, columns, uuid.uuid4().hex, overwrite

    def write(self, iterator):
        store, folder = _store(self.path)
        name = None
        lines = (json.dumps({c: v for c, v in zip(self.columns, row, strict=True) if v is not None}, default=str) for row in iterator)
        first = next(lines, None)
        if first is not None:
            store.create_dir(f"{folder}/_{self.job}", recursive=True)
            name = f"{uuid.uuid4().hex}.json"
            with store.open_output_stream(f"{folder}/_{self.job}/{name}") as out:
                out.write(f"{first}\n".encode())
                for line in lines:
                    out.write(f"{line}\n".encode())
        return _File(name)

    def _clear(self) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        if store.get_file_info(f"{folder}/_{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/_{self.job}")

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and f.extension == "json"]
        for m in messages:
            if m is not None and m.path:
                store.move(f"{folder}/_{self.job}/{m.path}", f"{folder}/{m.path}")
        for path in old if self.overwrite else []:
            store.delete_file(path)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()


class RunMetrics(DataSource):
    """The data source ``run_metrics``: rows of SCHEMA, of which any columns may be left out."""

    @classmethod
    def name(cls) -> str:
        return "run_metrics"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite, schema.names)


def log_metrics(spark: SparkSession, path: str, run: str, values: dict[str, float], step: int = 0, tags: dict[str, str] | None = None) -> None:
    """Appends the metrics of one run."""
    spark.dataSource.register(RunMetrics)
    rows = [(run, name, float(v), step, dict(tags or {})) for name, v in values.items()]
    spark.createDataFrame(rows, SCHEMA).write.format("run_metrics").mode("append").option("path", path).save()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All metrics below ``path``; unfinished jobs show nothing."""
    return spark.read.schema(SCHEMA).json(path)
