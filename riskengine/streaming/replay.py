"""A stream of a folder's CSV files that sees what is appended to a file and when one is replaced.

The offset keeps for each file how often it was replaced, how far it was read, and the
size, time and first bytes it had then. A file whose beginning is as it was and that has
grown is read on from where it ended; any other change of size, time or beginning makes it
a new file, read from its first line. A batch is formed once ``batch_rows`` lines are there,
and has that many, or once the oldest line has waited ``batch_seconds``, with what there is.

A record is a line (line ends within quotes are not understood). The first line of a file
names its columns; those of the schema that it lacks are null. A last line without an end
counts once the file has not changed for ``batch_seconds``. Spark does not tell a source
where its checkpoint stands before it asks for more, so what was read is also noted in the
file ``position``, by which batches have their size from the first one after a restart on. The driver looks for the ends
of ``batch_rows`` lines; the lines themselves are read in tasks, some megabytes each.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes that tell whether a file begins as before, bytes looked through at once, and bytes of a task.
_HEAD, _LOOK, _SPLIT = 4096, 1 << 20, 8 << 20


@dataclass
class Part(InputPartition):
    """The lines of a file between two places, and where its first line ends."""

    path: str
    header: int
    begin: int
    end: int

    def __init__(self, path: str, header: int, begin: int, end: int) -> None:
        super().__init__((path, begin, end))
        self.path, self.header, self.begin, self.end = path, header, begin, end


def _open(folder: str) -> tuple[pf.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        fs, path = pf.FileSystem.from_uri(folder)
        return fs, path
    return pf.LocalFileSystem(), folder


def _line_end(file: pa.NativeFile, at: int, size: int, lines: int) -> tuple[int, int]:
    """The place behind the ``lines``-th line end from a place, or behind the last one there is, and how many were passed."""
    seen, behind = 0, at
    while at < size and seen < lines:
        file.seek(at)
        block = file.read(min(_LOOK, size - at))
        here = block.count(b"\n")
        if seen + here < lines:
            if here:
                behind = at + block.rfind(b"\n") + 1
            seen += here
        else:
            spot = -1
            for _ in range(lines - seen):
                spot = block.find(b"\n", spot + 1)
            return at + spot + 1, lines
        at += len(block)
    return behind, seen


class ReplayReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]) -> None:
        self.schema, self.folder = schema, options["path"]
        self.rows = int(options["batchRows"]) if options.get("batchRows") else None
        self.seconds = float(options.get("batchSeconds", "0"))
        self.position = options.get("position")
        self._at = self._noted()  # the last offset given out
        self._since: float | None = None  # when lines were first seen that wait

    def _noted(self) -> dict | None:
        if not self.position:
            return None
        fs, path = _open(self.position)
        if fs.get_file_info(path).type == pf.FileType.NotFound:
            return {"files": "{}"}
        with fs.open_input_file(path) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _files(self, fs: pf.FileSystem, path: str) -> list[pf.FileInfo]:
        found = fs.get_file_info(pf.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted((f for f in found if f.is_file and f.path.endswith(".csv")), key=lambda f: f.path)

    def _known(self, fs: pf.FileSystem, info: pf.FileInfo, old: dict | None) -> dict:
        """What the offset has of a file, with its present size and time, and ``at`` where reading goes on."""
        now = {"size": info.size, "time": info.mtime_ns or 0}
        if old and (old["size"], old["time"]) == (now["size"], now["time"]):
            return old
        with fs.open_input_file(info.path) as f:
            head = f.read(min(_HEAD, info.size))
            first, _ = _line_end(f, 0, info.size, 1)
        if old:
            same = hashlib.sha256(head[: old["headed"]]).hexdigest() == old["head"] and info.size > old["size"]
            if same:
                return old | now
        n = len(head)
        return now | {"version": old["version"] + 1 if old else 0, "at": first, "header": first, "headed": n, "head": hashlib.sha256(head).hexdigest()}

    def latestOffset(self) -> dict:
        fs, path = _open(self.folder)
        restarted = self._at is None  # nothing tells what was read: all there is, of which Spark takes what is new
        before = {} if restarted else json.loads(self._at["files"])
        files, left, wait = dict(before), self.rows or (1 << 62), False
        whole, now = dict(before), time.time()
        for info in self._files(fs, path):
            name = info.path
            state = self._known(fs, info, before.get(name))
            if not state["header"]:  # not even the first line is whole
                continue
            quiet = now - state["time"] / 1e9 >= self.seconds
            with fs.open_input_file(name) as f:
                end, seen = _line_end(f, state["at"], info.size, left if not restarted else 1 << 62)
            if seen < left and quiet and end < info.size:  # a last line without an end
                end, seen = info.size, seen + 1
            whole[name] = state | {"at": end}
            if seen:
                wait = True
            left -= seen
            files[name] = whole[name]
            if left <= 0:
                break
        changed = json.dumps(files, sort_keys=True)
        if not wait:
            self._since = None
            # sizes and times alone are no news
            return self._at if self._at is not None else {"files": changed}
        self._since = self._since if self._since is not None else now
        full = self.rows is not None and left <= 0
        if not (full or restarted or now - self._since >= self.seconds):
            return self._at
        self._at, self._since = {"files": changed}, None
        return self._at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        fs, _ = _open(self.folder)
        old, out = json.loads(start["files"]), []
        for name, f in json.loads(end["files"]).items():
            was = old.get(name)
            at = was["at"] if was and was["version"] == f["version"] else f["header"]
            if at >= f["at"]:
                continue
            with fs.open_input_file(name) as file:
                while at < f["at"]:
                    to = min(at + _SPLIT, f["at"])
                    if to < f["at"]:
                        to = max(_line_end(file, to, f["at"], 1)[0], to)
                        to = f["at"] if to == at + _SPLIT else to
                    out.append(Part(name, f["header"], at, to))
                    at = to
        # Spark has the batch in its log by now: it is run, or run again, before any other
        self._at = end
        self._note(end)
        return out

    def _note(self, end: dict) -> None:
        if self.position:
            fs, path = _open(self.position)
            with fs.open_output_stream(f"{path}.part") as f:
                f.write(json.dumps(end).encode())
            fs.move(f"{path}.part", path)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.folder)
        with fs.open_input_file(partition.path) as f:
            header = f.read(partition.header)
            f.seek(partition.begin)
            body = f.read(partition.end - partition.begin)
        kinds = to_arrow_schema(self.schema)
        texts = pc.ConvertOptions(column_types={k.name: k.type for k in kinds}, null_values=["", "nan", "NaN", "Nan"], strings_can_be_null=True, include_columns=kinds.names, include_missing_columns=True)
        yield from pc.read_csv(io.BytesIO(header + body), convert_options=texts).cast(kinds).to_batches()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ReplaySource(DataSource):
    """``spark.readStream.format("csv_replay")``; options ``path``, ``batchRows``, ``batchSeconds`` and ``position``."""

    @classmethod
    def name(cls) -> str:
        return "csv_replay"

    def streamReader(self, schema: T.StructType) -> ReplayReader:
        return ReplayReader(schema, self.options)


def replay_csv(spark: SparkSession, path: str, schema: T.StructType, batch_rows: int | None = None, batch_seconds: float = 0.0, position: str | None = None) -> DataFrame:
    """The folder as a stream (see above). Without ``batch_rows`` a batch has all there is.

    ``position``, a file that belongs with the stream's checkpoint, is needed with ``batch_rows``.
    """
    if batch_rows and not position:
        raise ValueError("batches of a size need a file for the position, beside the checkpoint")
    spark.dataSource.register(ReplaySource)
    reader = spark.readStream.format("csv_replay").schema(schema).option("path", path).option("batchSeconds", str(batch_seconds))
    for name, value in (("batchRows", batch_rows), ("position", position)):
        reader = reader.option(name, str(value)) if value else reader
    return reader.load()
