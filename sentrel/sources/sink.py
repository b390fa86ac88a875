"""Immutable JSON files as a data source writer: staged by tasks, committed by name and digest."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .manifests import canonical


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: (name, digest, place) of every file."""

    files: list[tuple[str, str, str]] = field(default_factory=list)


def _digest(files: fs.FileSystem, path: str) -> str:
    whole = hashlib.sha256()
    with files.open_input_stream(path) as f:
        while data := f.read(1 << 20):
            whole.update(data)
    return whole.hexdigest()


class JsonFileWriter(DataSourceWriter):
    """Files under hidden names until all tasks have written and no name holds other content."""

    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"_staged-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, root = self._folder()
        place, out = f"{root}/{self.staging}/{TaskContext.get().taskAttemptId()}", Staged()
        for row in iterator:
            if not row.name or "/" in row.name or row.name.startswith(("_", ".")):
                raise ValueError(f"not a file name: {row.name!r}")
            content = canonical(json.loads(row.content))
            if not out.files:
                files.create_dir(place, recursive=True)
            to = f"{place}/{len(out.files)}"
            with files.open_output_stream(to) as f:
                f.write(content)
            out.files.append((row.name, hashlib.sha256(content).hexdigest(), to))
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        """All names are looked at before any file appears; those that are there with equal content stay as they are."""
        files, root = self._folder()
        new: dict[str, tuple[str, str]] = {}
        for name, sha, place in (f for m in messages if m for f in m.files):
            if new.setdefault(name, (sha, place))[0] != sha:
                raise FileExistsError(f"{name} is written twice with different content")
        there = [f"{root}/{name}" for name in new]
        for (name, (sha, _)), info in zip(list(new.items()), files.get_file_info(there), strict=True):
            if info.type != fs.FileType.NotFound:
                if _digest(files, info.path) != sha:
                    raise FileExistsError(f"{name} exists with other content")
                del new[name]
        for name, (_, place) in new.items():
            files.move(place, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = self._folder()
        if files.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


class JsonFiles(DataSource):
    """df.write.format("json_files").mode("append").save(path): a file for each row (name, content).

    Content is written as canonical JSON. A file that exists is never changed: equal content is
    passed over, other content fails the write, which then leaves nothing. Readers skip the staging
    folder by its name.
    """

    @classmethod
    def name(cls) -> str:
        return "json_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> JsonFileWriter:
        if overwrite:
            raise ValueError("files are never overwritten; use mode append")
        return JsonFileWriter(self.options["path"])
