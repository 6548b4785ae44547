"""Source trees and git histories as Spark data sources: each plans its own partitions and reads them on executors.

Both read folders that the driver and the executors see under one path.
"""

from __future__ import annotations

import json
import os
import subprocess
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import LANGUAGE_OF

#: A batch on its way to Spark holds about so many bytes or files, a partition of a history so many commits.
BATCH_BYTES, BATCH_FILES, COMMITS = 4 << 20, 500, 2000
FILES = pa.schema([("path", pa.string()), ("source", pa.string()), ("language", pa.string()), ("problem", pa.string())])
LOG = pa.schema([("path", pa.string()), ("committed", pa.string()), ("commit", pa.string())])


def language_of(name: str) -> str | None:
    stem, dot, suffix = name.rpartition(".")
    return LANGUAGE_OF.get(suffix.lower()) if stem and dot else None


def batched(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES or len(held) >= BATCH_FILES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


@dataclass
class Folder(InputPartition):
    """The files in a folder (``deep``: and below it) whose names fall to ``share`` of ``shares``."""

    path: str
    deep: bool
    share: int
    shares: int


class SourceTree(DataSource):
    """Every supported file below ``root``: path (relative), source, language; a file or folder that cannot be read has a
    ``problem`` in place of its source.

    Options: root; skipped, a JSON list of folder names, which are left out by name and never opened; partitions, how many
    are wanted. The driver opens folders from the top until there are enough and holds no names of files; what lies below
    is listed and read by the tasks. Links to folders are not followed.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, source string, language string, problem string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["root"], frozenset(json.loads(self.options.get("skipped", "[]"))), int(self.options.get("partitions", "32")))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skipped: frozenset[str], wanted: int):
        self.root, self.skipped, self.wanted = root, skipped, wanted

    def folders_in(self, path: str) -> Iterator[str]:
        with os.scandir(os.path.join(self.root, path)) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False) and e.name not in self.skipped:
                    yield os.path.join(path, e.name)

    def partitions(self) -> list[Folder]:
        flat, open_ = [], deque([""])
        while open_ and len(flat) + len(open_) < self.wanted:
            path = open_.popleft()
            try:
                open_.extend(self.folders_in(path))
            except OSError:
                pass  # the task that reads the folder says so
            flat.append(path)
        shares = max(1, self.wanted // max(1, len(flat) + len(open_)))  # few folders: their files are dealt out
        return [Folder(p, deep, k, shares) for paths, deep in ((flat, False), (open_, True)) for p in paths for k in range(shares)]

    def rows(self, part: Folder) -> Iterator[tuple]:
        left = [part.path]
        while left:
            folder = left.pop()
            try:
                with os.scandir(os.path.join(self.root, folder)) as entries:
                    found = [e for e in entries if e.name not in self.skipped or not e.is_dir(follow_symlinks=False)]
            except OSError as e:
                if part.share == 0:
                    yield folder, None, None, str(e)
                continue
            for e in found:
                path = os.path.join(folder, e.name)
                if e.is_dir(follow_symlinks=False):
                    if part.deep:
                        left.append(path)
                    continue
                language = language_of(e.name)
                if language is None or zlib.crc32(os.fsencode(e.name)) % part.shares != part.share:
                    continue
                try:
                    if e.is_file():
                        with open(os.path.join(self.root, path), "rb") as f:
                            yield path, f.read().decode("utf-8", errors="replace"), language, None
                except OSError as e:
                    yield path, None, language, str(e)

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        yield from batched(self.rows(part), FILES, lambda row: len(row[1] or ""))


@dataclass
class Commits(InputPartition):
    skip: int
    n: int


def git(root: str, *args: str) -> str:
    """What a git command prints; RuntimeError with what it complains about where it fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    except OSError as e:
        raise RuntimeError(str(e)) from e
    if done.returncode:
        raise RuntimeError(done.stderr.strip())
    return done.stdout


class GitLog(DataSource):
    """path, committed (ISO time), commit: one row for each file of each commit that ``head`` reaches.

    Options: root; head, a commit, so that all tasks read one history; since, as git takes it (none: all). Tasks read ranges of
    COMMITS commits, one line at a time. Paths are relative to ``root`` and those outside it left out.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "path string, committed string, commit string"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["root"], self.options["head"], self.options.get("since"))


class LogReader(DataSourceReader):
    def __init__(self, root: str, head: str, since: str | None):
        self.root, self.head, self.limits = root, head, [f"--since={since}"] if since else []

    def partitions(self) -> list[Commits]:
        n = int(git(self.root, "rev-list", "--count", *self.limits, self.head))
        return [Commits(k, COMMITS) for k in range(0, max(n, 1), COMMITS)]

    def rows(self, part: Commits) -> Iterator[tuple]:
        command = ["git", "-c", "core.quotepath=off", "-C", self.root, "log", *self.limits, f"--skip={part.skip}", f"--max-count={part.n}", "--name-only", "--no-renames", "--relative", "--pretty=format:\x01%cI %H", self.head]
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace") as run:
            when = commit = ""
            for line in run.stdout:
                line = line.rstrip("\n")
                if line.startswith("\x01"):
                    when, commit = line[1:].split(" ")
                elif line:
                    yield line, when, commit
            complaint = run.stderr.read()
        if run.returncode:
            raise RuntimeError(complaint.strip())

    def read(self, part: Commits) -> Iterator[pa.RecordBatch]:
        yield from batched(self.rows(part), LOG, lambda row: len(row[0]))
