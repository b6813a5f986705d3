"""A data source that writes rows as JSON arrays and commits them at once.

Each task writes one file, an array of its rows with an indent of two and characters
beyond ASCII as they are, into a folder beside the goal.  Once all tasks are done
the folder takes the goal's place: the old one is moved aside, the new one into its
place, and the old one is deleted.  If a task fails, the new folder goes and the old one
stays, so a reader finds one or the other, in the instant between the moves none, and
never a part.  Files keep the order of the tasks by name.  Rows go out as they come,
and a task holds one at a time.

The path is one that all executors share, a folder or an address that Arrow's file
systems know.  ``append`` is refused, since arrays can't be appended to."""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclasses.dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns
        self.aside = f"{self.path}.new-{uuid.uuid4().hex}"
        # made here alone: a task that outlives commit or abort finds no folder and fails
        system, new = self._open(self.aside)
        system.create_dir(new, recursive=True)

    def _open(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))

    def write(self, iterator: Iterator[Row]) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = self._open(self.aside)
        # a second attempt writes a file of its own; commit takes the one that was reported
        name, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.json", 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                text = json.dumps(dict(zip(self.columns, map(_plain, row))), ensure_ascii=False, indent=2)
                out.write(((",\n" if n else "[\n") + "\n".join("  " + line for line in text.split("\n"))).encode())
                n += 1
            out.write(b"\n]\n" if n else b"[]\n")
        return _Part(name, n)

    def commit(self, messages: list[_Part]) -> None:
        from pyarrow import fs

        system, new = self._open(self.aside)
        _, goal = self._open(self.path)
        kept = {m.name for m in messages if m is not None}
        for found in system.get_file_info(fs.FileSelector(new)):
            if found.base_name not in kept:
                system.delete_file(found.path)
        old = f"{goal}.old-{uuid.uuid4().hex}"
        there = system.get_file_info(goal).type != fs.FileType.NotFound
        if there:
            system.move(goal, old)
        system.move(new, goal)
        if there:
            system.delete_dir(old)

    def abort(self, messages: list[_Part]) -> None:
        from pyarrow import fs

        system, new = self._open(self.aside)
        # a task still running may open its one file while the folder is emptied
        for left in range(len(messages), -1, -1):
            if system.get_file_info(new).type == fs.FileType.NotFound:
                break
            try:
                system.delete_dir(new)
            except OSError:
                if not left:
                    raise


def _plain(value):
    """Rows as objects, and what JSON lacks as text."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


class JsonArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if not overwrite:
            raise ValueError("a JSON array can't be appended to; use mode overwrite")
        return _Writer(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonArrays)
