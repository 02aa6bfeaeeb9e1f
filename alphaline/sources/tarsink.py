"""Tar shards as a Spark sink with a commit: the manifest appears only when every shard is whole.

``rows.write.format("tarshards").option("path", folder).mode("append").save()`` takes rows ``(shard,
member, content)``, the rows of a shard together and in order (``write_shards`` sees to that). A task
writes each of its shards to a part file named after the run, reads it again to count its members,
and sends a message with names, pairs and bytes. Only when all tasks have ended does the driver
compare bytes and totals, give the parts their names and, last, write ``_manifest.json`` by a
rename. If a task fails, nothing gets a name: parts of the run are removed and an older
manifest stays as it is. Shards that an older manifest lists with the same pairs, and whose files have
the bytes listed there, are neither shuffled nor written again (``write_shards`` finds them).
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from alphaline.sources.archives import _system

MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """Manifest entries of a task's shards, and the part files behind those that are new."""

    entries: list[dict] = field(default_factory=list)
    parts: dict[str, str] = field(default_factory=dict)


def read_manifest_file(folder: str) -> dict:
    """What the folder's manifest says; empty without one."""
    system, base = _system(folder)
    if system.get_file_info(f"{base}/{MANIFEST}").type != pa_fs.FileType.File:
        return {}
    with system.open_input_stream(f"{base}/{MANIFEST}") as stream:
        return json.loads(stream.read())


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.run = options["path"], uuid.uuid4().hex
        self.pairs = options.get("pairs")
        self.kept = json.loads(options.get("kept", "[]"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _system(self.folder)
        system.create_dir(base)
        done = Written()
        rows = ((s, m, c) for batch in iterator for s, m, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            part, sent = f"{base}/.{self.run}.{uuid.uuid4().hex}", 0
            with system.open_output_stream(part) as sink, tarfile.open(fileobj=sink, mode="w|") as archive:
                for _, member, content in own:
                    info = tarfile.TarInfo(member)
                    info.size = len(content)
                    archive.addfile(info, io.BytesIO(content))
                    sent += 1
            with system.open_input_file(part) as stream, tarfile.open(fileobj=stream, mode="r:") as archive:
                found = sum(1 for _ in archive)
            if found != sent or sent % 2:
                raise RuntimeError(f"{shard}: {found} members of {sent} were written; pairs have two")
            done.entries.append({"name": shard, "pairs": sent // 2, "files": sent, "bytes": system.get_file_info(part).size})
            done.parts[shard] = part
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _system(self.folder)
        sound = [m for m in messages if m is not None]
        entries = sorted([*self.kept, *(e for m in sound for e in m.entries)], key=lambda e: e["name"])
        parts = {shard: part for m in sound for shard, part in m.parts.items()}
        names = [e["name"] for e in entries]
        total = sum(e["pairs"] for e in entries)
        wrong = [e["name"] for e in entries if system.get_file_info(parts.get(e["name"], f"{base}/{e['name']}")).size != e["bytes"]]
        if len(set(names)) != len(names) or wrong or (self.pairs is not None and total != int(self.pairs)):
            self.abort(messages)
            raise RuntimeError(f"shards are not whole: {len(names)} names, {len(set(names))} different, {total} pairs of {self.pairs}, wrong bytes in {wrong}")
        for shard, part in parts.items():
            system.move(part, f"{base}/{shard}")
        told = json.dumps({"shards": entries, "total_pairs": total}, ensure_ascii=False, indent=2)
        fresh = f"{base}/.{self.run}.manifest"
        with system.open_output_stream(fresh) as sink:
            sink.write(told.encode())
        system.move(fresh, f"{base}/{MANIFEST}")
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _system(self.folder)
        self._clear(system, base)

    def _clear(self, system: pa_fs.FileSystem, base: str) -> None:
        """Remove the run's part files, those of failed and doubled tasks too."""
        for file in system.get_file_info(pa_fs.FileSelector(base, allow_not_found=True)):
            if file.base_name.startswith(f".{self.run}."):
                system.delete_file(file.path)


class TarShardSink(DataSource):
    """Writes rows ``(shard, member, content)`` as one tar a shard."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return "shard string, member string, content binary"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options))


def whole_shards(members: DataFrame, folder: str) -> list[dict]:
    """Manifest entries of the shards that are on disk as listed, and would get as many members again."""
    known = {e["name"]: e for e in read_manifest_file(folder).get("shards", [])}
    if not known:
        return []
    system, base = _system(folder)
    there = [name for name, e in known.items() if system.get_file_info(f"{base}/{name}").size == e["bytes"] > 0]
    counts = members.where(F.col("shard").isin(there)).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()
    return [known[r["shard"]] for r in counts if known[r["shard"]]["files"] == r["n"]]


def write_shards(members: DataFrame, folder: str, pairs: int | None = None) -> None:
    """Write ``members(shard, member, content)``; with ``pairs`` the total has to agree as well."""
    members.sparkSession.dataSource.register(TarShardSink)
    kept = whole_shards(members.select("shard"), folder)
    fresh = members.select("shard", "member", "content")
    if kept:
        fresh = fresh.where(~F.col("shard").isin([e["name"] for e in kept]))
    placed = fresh.repartition("shard").sortWithinPartitions("shard", "member")
    sink = placed.write.format("tarshards").option("path", folder).option("kept", json.dumps(kept)).mode("append")
    (sink if pairs is None else sink.option("pairs", str(pairs))).save()


def shard_entries(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, pairs, files, bytes)`` of the folder's manifest; none without one."""
    shards = read_manifest_file(folder).get("shards", [])
    return spark.createDataFrame([(e["name"], e["pairs"], e["files"], e["bytes"]) for e in shards], "name string, pairs long, files long, bytes long")
