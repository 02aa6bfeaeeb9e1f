"""Archives as a Spark data source: many tasks read one archive, a pattern reaches the planning.

``spark.dataSource.register(ArchiveSource)``, then ``spark.read.format("archives").option("path",
folder).load()`` gives a row for each file in the folder's zip or tar archives. Archives larger than
``splitBytes`` are indexed while the scan is planned (a zip's directory, an uncompressed tar's
headers; no contents) and cut into runs of members of about that size, one task each. The option
``pattern`` (a regular expression on members) is applied to the index: what it rules out is never read
and gets no task. Filters of a DataFrame are applied to rows that were read: the reader takes none, as
Spark 4.1 keeps a pushed filter with the table, so that other reads of the same DataFrame would
lose rows by it (tried: 60 of 120).

Archives are opened through ``pyarrow.fs`` where they lie. One that is broken has one row with its
``error``, or raises with the option ``onError=raise``. A gzipped tar can't be cut: one task streams it.
"""

from __future__ import annotations

import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, folder string, name string, stem string, bytes bigint, content binary, error string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("folder", pa.string()), ("name", pa.string()), ("stem", pa.string()), ("bytes", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
_KINDS = {".zip": "zip", ".tar": "tar", ".tar.gz": "stream", ".tgz": "stream"}
_BATCH_BYTES = 8 << 20
SPLIT_BYTES = 64 << 20
#: What readers raise for a file that is no whole archive; a file that is too short for its kind can't be sought in.
BROKEN = (tarfile.TarError, zipfile.BadZipFile, pa.ArrowInvalid)


@dataclass
class Members(InputPartition):
    """A task: all members of an archive, or those at these places (``(name, offset, bytes)``; a zip's offset is its place in the directory)."""

    archive: str
    kind: str
    chosen: list[tuple[str, int, int]] | None


def _parts(member: str) -> dict[str, str]:
    folder, _, name = member.rpartition("/")
    dot = name.rfind(".")
    return {"member": member, "folder": folder, "name": name, "stem": name[:dot] if dot > 0 else name}


def _system(uri: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^(file:)?/+", "file:///", uri))


def _uri(base: str, path: str) -> str:
    """The URI of a path on the file system of ``base``."""
    scheme, _, rest = base.partition("://")
    if not rest:
        return f"file://{path}"
    return f"{scheme}://{rest.split('/', 1)[0]}{path}" if path.startswith("/") else f"{scheme}://{path}"


def kind_of(path: str) -> str | None:
    return next((kind for end, kind in _KINDS.items() if path.lower().endswith(end)), None)


def index(archive: str, kind: str) -> list[tuple[str, int, int]]:
    """``(member, offset, bytes)`` of an archive's files, in their order; contents are not read."""
    system, at = _system(archive)
    with system.open_input_file(at) as stream:
        if kind == "zip":
            with zipfile.ZipFile(stream) as opened:
                return [(i.filename, no, i.compress_size) for no, i in enumerate(opened.infolist()) if not i.is_dir()]
        with tarfile.open(fileobj=stream, mode="r:") as opened:
            return [(i.name, i.offset_data, i.size) for i in opened if i.isfile()]


def contents(archive: str, kind: str, chosen: list[tuple[str, int, int]] | None, wanted: Callable[[str], bool]) -> Iterator[tuple[str, bytes]]:
    """The wanted members of a task, one at a time."""
    system, at = _system(archive)
    if kind == "tar" and chosen is not None:
        with system.open_input_file(at) as stream:
            for name, offset, size in chosen:
                stream.seek(offset)
                yield name, stream.read(size)
    elif kind == "zip":
        with system.open_input_file(at) as stream, zipfile.ZipFile(stream) as opened:
            listed = opened.infolist()
            for info in [listed[no] for _, no, _ in chosen] if chosen is not None else [i for i in listed if not i.is_dir()]:
                if wanted(info.filename):
                    yield info.filename, opened.read(info)
    else:
        with system.open_input_stream(at, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as opened:
            for info in opened:
                if info.isfile() and wanted(info.name):
                    yield info.name, opened.extractfile(info).read()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.pattern = re.compile(options.get("pattern", ""))
        self.split_bytes = int(options.get("splitBytes", options.get("splitbytes", SPLIT_BYTES)))
        self.strict = options.get("onError", options.get("onerror", "row")) == "raise"

    def wanted(self, member: str) -> bool:
        return bool(self.pattern.search(member))

    def _archives(self) -> list[tuple[str, int]]:
        system, at = _system(self.path)
        found = system.get_file_info(at)
        files = [found] if found.type == pa_fs.FileType.File else system.get_file_info(pa_fs.FileSelector(at))
        return sorted((_uri(self.path, f.path), f.size) for f in files if f.type == pa_fs.FileType.File and kind_of(f.path))

    def partitions(self) -> list[Members]:
        tasks: list[Members] = []
        for archive, size in self._archives():
            kind = kind_of(archive)
            if kind == "stream" or size <= self.split_bytes:
                tasks.append(Members(archive, kind, None))
                continue
            try:
                chosen = [m for m in index(archive, kind) if self.wanted(m[0])]
            except BROKEN:
                tasks.append(Members(archive, kind, None))  # the task tells what is wrong
                continue
            held = self.split_bytes
            for member in chosen:
                if held >= self.split_bytes:
                    tasks.append(Members(archive, kind, []))
                    held = 0
                tasks[-1].chosen.append(member)
                held += member[2]
        return tasks

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where nothing was planned
            return
        rows, held = [], 0
        try:
            for member, content in contents(partition.archive, partition.kind, partition.chosen, self.wanted):
                rows.append({"archive": partition.archive, **_parts(member), "bytes": len(content), "content": content, "error": None})
                held += len(content)
                if held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        except BROKEN as error:
            if self.strict:
                raise
            rows.append({"archive": partition.archive, "error": f"{type(error).__name__}: {error}"})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class ArchiveSource(DataSource):
    """Files inside zip and tar archives."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def archive_members(spark: SparkSession, path: str, pattern: str = "", split_bytes: int = SPLIT_BYTES, **options: str) -> DataFrame:
    """The members of a folder's archives (or of one) that match ``pattern``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").options(path=path, pattern=pattern, splitBytes=str(split_bytes), **options).load()


def folder_pairs(members: DataFrame, images: str = "im", truths: str = "gt") -> DataFrame:
    """``(stem, image, truth)`` of members in ``<group>/<images>`` and ``<group>/<truths>`` that share a stem.

    Pairs are made inside a group, whatever archive its files came in; the group's own name is put
    before the stem, as stems may come again in other groups. Files named ``._*`` are none; of a
    group's truths of one stem the last by name counts; an image without a truth is left out.
    """
    sound = members.where("error IS NULL").where(~F.col("name").startswith("._"))
    placed = sound.select(F.regexp_extract("folder", "^(.*?)/?[^/]*$", 1).alias("group"), F.regexp_extract("folder", "([^/]*)$", 1).alias("side"), "stem", "name", "content")
    truth = placed.where(F.col("side") == truths).groupBy("group", "stem").agg(F.max_by("content", "name").alias("truth"))
    paired = placed.where(F.col("side") == images).join(truth, ["group", "stem"])
    return paired.select(F.concat_ws("_", F.regexp_extract("group", "([^/]*)$", 1), "stem").alias("stem"), F.col("content").alias("image"), "truth")
