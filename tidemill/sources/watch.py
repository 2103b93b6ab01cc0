"""Streams over files that grow or change in place, which Spark's file source reads once only."""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bytes read at once when the begin of a line is sought.
STEP = 1 << 16


class _Folders(InputPartition):
    """Folders to list, each with whether to list what is below it, and the times between which files have changed."""

    def __init__(self, folders: list[tuple[str, bool]], after: int, until: int):
        self.folders, self.after, self.until = folders, after, until


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listing(files, path: str, below: bool):
    from pyarrow import fs

    return files.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=below))


class _Reader(DataSourceStreamReader):
    """A position is a time: files modified after it are yet to come. Its size doesn't depend on the files.

    Tasks list the folders and compare times; the driver lists at most the first level, to deal folders out.
    """

    def __init__(self, options):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.recursive, self.existing = options.get("recursive", "false") == "true", options.get("existing", "true") == "true"
        self.settle, self.tasks = float(options.get("settle", 1)), int(options.get("tasks", 64))

    def initialOffset(self) -> dict:
        return {"at": 0 if self.existing else time.time_ns()}

    def latestOffset(self, *_) -> dict:
        now = time.time_ns()
        time.sleep(self.settle)  # by then all files modified until ``now`` can be seen
        return {"at": now}

    def partitions(self, start: dict, end: dict) -> list:
        from pyarrow import fs

        files, root = file_system(self.folder)
        folders = [(root, False)]
        if self.recursive:
            folders += [(f.path, True) for f in _listing(files, root, False) if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))]
        n = min(self.tasks, len(folders))
        return [_Folders(folders[k::n], start["at"], end["at"]) for k in range(n)]

    def read(self, part: _Folders):
        from datetime import datetime

        from pyarrow import fs

        files, _ = file_system(self.folder)
        for path, below in part.folders:
            for f in _listing(files, path, below):
                if f.type == fs.FileType.File and part.after < (f.mtime_ns or 0) <= part.until and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("_", ".")):
                    yield f.path, f.size, datetime.fromtimestamp(f.mtime_ns / 1e9)


class FileChanges(DataSource):
    """``format("file_changes")``: path, size and modified of each file of a folder that is new, or changed since the batch before.

    Options: path, pattern, recursive, ``existing`` (false: files there at the first start do not count), ``settle`` (seconds until a
    change can be seen from all machines, their clocks' differences included) and ``tasks`` (at most so many list folders at once). A file that is changed
    again before a batch lists it comes in the next batch; one that gets an older time than the batch before, by a move that keeps times, does not come.
    """

    @classmethod
    def name(cls):
        return "file_changes"

    def schema(self):
        return "path string, size long, modified timestamp"

    def streamReader(self, schema):
        return _Reader(self.options)


def lines_ended(file, start: int, end: int):
    """Lines whose line feed is within [start, end) of a file. A line in writing comes whole once it has ended."""
    begin, held = start, b""
    while begin > 0 and b"\n" not in held:
        step = min(STEP, begin)
        begin -= step
        file.seek(begin)
        held = file.read(step) + held
    rest = held.rsplit(b"\n", 1)[-1]
    file.seek(start)
    while start < end:
        data = file.read(min(STEP, end - start))
        if not data:
            return
        start += len(data)
        *ended, rest = (rest + data).split(b"\n")
        yield from ended


def grown(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What was added to a file since it was read last; the state is its size then. A file that got shorter is read from its begin."""
    size = max(int(r["size"].iloc[r["modified"].argmax()]) for r in rows)
    before = state.get[0] if state.exists else 0
    state.update((size,))
    yield pd.DataFrame({"path": [key[0]], "start": [before if before <= size else 0], "end": [size]})


def added_lines(changes: DataFrame, folder: str) -> DataFrame:
    """line and file name of what was added to changed files. Sizes read so far are Spark's keyed state, spread over tasks."""

    def read(batches):
        for batch in batches:
            found = []
            for path, start, end in batch.itertuples(index=False):
                files, _ = file_system(folder)
                with files.open_input_file(path) as f:
                    found += [(line.decode("utf-8", "replace"), path.rsplit("/", 1)[-1]) for line in lines_ended(f, start, end)]
            yield pd.DataFrame(found, columns=["line", "file"])

    spans = changes.groupBy("path").applyInPandasWithState(grown, "path string, start long, end long", "size long", "append", GroupStateTimeout.NoTimeout)
    return spans.filter("end > start").mapInPandas(read, "line string, file string")
