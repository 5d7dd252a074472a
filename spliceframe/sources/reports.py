"""Result tables as one ordered text file for each group of rows, as a sample and an event type, that appear all at once or not at all.

Tasks write their groups' files to a folder of their own attempt; only when all tasks are through are the files renamed to their places, and if any fails, or is tried again, what the
attempts wrote goes. A reader never meets half a table, nor a file twice."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _ReportWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.job = path, columns, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        """Rows of a file stand together: (_file, _line), in the order of the lines."""
        fs, root = _filesystem(self.path)
        task = TaskContext.get()
        own = posixpath.join(root, f"_writing-{self.job}", f"{task.partitionId()}-{task.taskAttemptId()}")
        out, name, files = None, None, []
        try:
            for row in rows:
                if row["_file"] != name:
                    if out is not None:
                        out.close()
                    name = row["_file"]
                    at = posixpath.join(own, f"{len(files)}.tsv")
                    fs.create_dir(own, recursive=True)
                    out = fs.open_output_stream(at)
                    out.write(("\t".join(self.columns) + "\n").encode())
                    files.append((at, posixpath.join(root, name)))
                out.write((row["_line"] + "\n").encode("utf-8", "surrogatepass"))
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _filesystem(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if len({to for _, to in files}) != len(files):
            raise ValueError("rows of one file came from several tasks")
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(root)):
                if info.base_name != f"_writing-{self.job}":
                    (fs.delete_dir if info.type == pafs.FileType.Directory else fs.delete_file)(info.path)
        for at, to in files:
            fs.create_dir(posixpath.dirname(to), recursive=True)
            fs.move(at, to)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _filesystem(self.path)
        here = posixpath.join(root, f"_writing-{self.job}")
        if fs.get_file_info(here).type == pafs.FileType.Directory:
            fs.delete_dir(here)


class ReportDataSource(DataSource):
    """Options: path, columns (the header, separated by tabs)."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return "_file string, _line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ReportWriter(self.options["path"], self.options["columns"].split("\t"), overwrite)


def _safe(c: Column) -> Column:
    """A value as a file's name: slashes and what stands for other folders are escaped."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("null")), r"[/\\%\s]", "_"), r"^\.+", "_")


def write_reports(rows: DataFrame, path: str, name: list[str], order: list[str], folder: list[str] | None = None, hidden: list[str] | None = None) -> None:
    """One tab-separated file with a header for each group: path/<folder=value>/.../<name values>.tsv, its lines by the columns in `order`. Columns of folder stand in the path only, hidden ones
    are there for the order; a table is replaced as a whole.

    A group is one task's work: tables by sample are as long as an annotation. Tabs and line ends within values become spaces. Without rows there is no file."""
    folder = folder or []
    columns = [c for c in rows.columns if c not in folder and c not in (hidden or [])]
    file = F.concat(*[F.concat(F.lit(f"{c}="), _safe(F.col(c)), F.lit("/")) for c in folder], F.concat_ws("-", *[_safe(F.col(c)) for c in name]) if name else F.lit("all"), F.lit(".tsv"))
    line = F.concat_ws("\t", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in columns])
    keys = [F.col(k) for k in ("_file", *[f"_o{i}" for i in range(len(order))])]
    dealt = rows.select(file.alias("_file"), line.alias("_line"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]).repartition("_file").sortWithinPartitions(*keys)
    rows.sparkSession.dataSource.register(ReportDataSource)
    dealt.select("_file", "_line").write.format("report").mode("overwrite").options(path=path, columns="\t".join(columns)).save()
