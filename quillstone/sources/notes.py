"""Notes written back as files: one a row, all of a job or none."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import frontmatter


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    paths: list[str]


def safe(path: str) -> str:
    """A path below the vault; one that would leave it is refused."""
    clean = posixpath.normpath(path)
    if clean.startswith(("/", "../")) or clean in ("..", "."):
        raise ValueError(f"{path!r} is not a path below the vault")
    return clean


class NoteFiles(DataSource):
    """``df.write.format("notes").mode("append").save(folder)`` for rows (path, text); any file system that Arrow opens by its URI."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], list(schema.names))


class _Writer(DataSourceWriter):
    """Tasks write below a staging folder of their own; the commit moves files to their places, an abort deletes them."""

    def __init__(self, root: str, names: list[str]):
        self.root, self.names, self.job = root, names, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        return system, path.rstrip("/")

    def write(self, iterator: Iterator) -> _Staged:
        system, root = self._open()
        context = TaskContext.get()
        folder = f"{root}/.staging-{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        at, text, paths = self.names.index("path"), self.names.index("text"), []
        for row in iterator:
            path = safe(row[at])
            system.create_dir(posixpath.dirname(f"{folder}/{path}"), recursive=True)
            with system.open_output_stream(f"{folder}/{path}") as out:
                out.write((row[text] or "").encode())
            paths.append(path)
        return _Staged(folder, paths)

    def commit(self, messages: list[_Staged | None]) -> None:
        system, root = self._open()
        for m in messages:
            for path in m.paths if m else []:
                system.create_dir(posixpath.dirname(f"{root}/{path}"), recursive=True)
                system.move(f"{m.folder}/{path}", f"{root}/{path}")
        self._clear(system, root)

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clear(*self._open())

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        staging = f"{root}/.staging-{self.job}"
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


def save(notes: DataFrame, folder: str, now: str) -> None:
    """Write notes (path, frontmatter as JSON, body), one a path, with ``updated`` set to ``now`` and one blank line before the body."""
    notes.sparkSession.dataSource.register(NoteFiles)
    text = frontmatter.dumped(frontmatter.bumped(F.col("frontmatter"), now), F.regexp_replace("body", r"^\n+", ""))
    notes.select("path", text.alias("text")).write.format("notes").mode("append").save(folder)
