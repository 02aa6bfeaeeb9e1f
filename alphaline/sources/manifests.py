"""Manifest and archive sources and sinks."""

from __future__ import annotations

import io
import re
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from alphaline.functions import text as tx

# The categories of the manifest contract.
CATEGORIES = (
    "hair", "transparent", "thin", "product", "complex", "illustration",
    "general", "camouflage", "text", "fx", "design",
    "design_real",
)
KEYS = ("id", "image", "category", "gt_alpha")
SCHEMA = "id string, image string, category string, gt_alpha string"


def read_manifest(spark: SparkSession, path: str, categories=CATEGORIES) -> DataFrame:
    """A strict JSON-lines manifest: blank lines are skipped; a row that is no JSON object, lacks one
    of the four keys (``gt_alpha`` may be null, but not absent), has an unknown category or repeats an
    id raises.

    The id check is a join with the ids found twice, so it costs one shuffle of ids.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", SCHEMA).alias("r"), F.json_object_keys("value").alias("keys")).select("value", "keys", "r.*")
    whole = F.coalesce(F.size(F.array_intersect("keys", F.array(*map(F.lit, KEYS)))) == len(KEYS), F.lit(False))
    bad = ~whole | ~F.trim("value").rlike(r"(?s)^\{.*\}$") | F.col("id").isNull() | F.col("image").isNull() | F.col("category").isNull() | ~F.col("category").isin(*categories)
    twice = rows.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("__twice"))
    marked = rows.join(twice, "id", "left")
    checked = F.when(bad | F.col("__twice").isNotNull(), F.raise_error(F.concat(F.lit("invalid manifest row: "), "value"))).otherwise(F.col("id"))
    return marked.select(checked.alias("id"), "image", "category", "gt_alpha")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Lenient ``(id, category)``: no checks; of equal ids the last line counts."""
    lines = spark.read.schema("id string, category string").json(path)
    numbered = lines.withColumn("__at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return numbered.where("id IS NOT NULL").groupBy("id").agg(F.max_by("category", "__at").alias("category"))


def _present(spark: SparkSession, path: str, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What ``read`` gives, or no rows where the path does not exist."""
    try:
        return read()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of an output manifest; a missing file has none."""
    return _present(spark, path, lambda: spark.read.schema("id string").json(path).where("id IS NOT NULL").distinct(), "id string")


def append_manifest(rows: DataFrame, path: str, categories=CATEGORIES) -> None:
    """Validated append of JSON lines; text is written as UTF-8, unescaped."""
    good = F.col("id").isNotNull() & F.col("image").isNotNull() & F.col("category").isin(*categories)
    checked = F.when(good, F.col("id")).otherwise(F.raise_error(F.lit("invalid manifest row")))
    rows.select(checked.alias("id"), "image", "category", "gt_alpha").write.mode("append").option("ignoreNullFields", "false").json(path)


def excluded_ids(spark: SparkSession, path: str) -> DataFrame:
    """A text file of ids: trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp"), recursive: bool = False, pattern: str = "*") -> DataFrame:
    """``(path, stem, extension, length)`` of a folder's files whose names fit a glob; contents are not read.

    A missing folder has none.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern)
    listed = _present(spark, folder, lambda: reader.load(folder).select("path", "length"), "path string, length long")
    listed = listed.select("path", "length", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))
    named = listed.withColumn("stem", tx.stem(F.col("path")))
    return named.where(F.col("extension").isin(*extensions) & ~F.regexp_extract("path", r"([^/]+)$", 1).startswith("._"))


def _zip_members(stream):
    with zipfile.ZipFile(stream) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                yield info.filename, lambda info=info: archive.read(info)


def _tar_members(stream):
    with tarfile.open(fileobj=stream, mode="r|*") as archive:
        for info in archive:
            if info.isfile():
                yield info.name, lambda info=info: archive.extractfile(info).read()


def read_archives(spark: SparkSession, path: str, kind: str, pattern: str = "") -> DataFrame:
    """``(archive, member, content)`` of zip or tar files whose members match ``pattern``.

    Archives are opened where they lie (any URI that ``pyarrow.fs`` knows) and read member by
    member, so one may be far larger than memory or a binary cell; what doesn't match isn't read.
    An archive that is broken has one row with its error as ``member`` and no content.
    """
    opened, wanted = {"zip": _zip_members, "tar": _tar_members}[kind], re.compile(pattern)
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with _open(name) as stream:
                        for member, read in opened(stream):
                            if wanted.search(member):
                                yield _row(archive=name, member=member, content=read())
                except (tarfile.TarError, zipfile.BadZipFile) as error:
                    yield _row(archive=name, member=f"{type(error).__name__}: {error}", content=None)

    return files.repartition("path").mapInArrow(run, "archive string, member string, content binary")


def _open(uri: str):
    system, at = pa_fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^(file:)?/+", "file:///", uri))
    return system.open_input_file(at)


def _row(**values) -> pa.RecordBatch:
    kinds = {"content": pa.binary(), "pairs": pa.int64(), "bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.string())) for k, v in values.items()], names=list(values))


def write_tars(members: DataFrame, folder: str) -> DataFrame:
    """Write ``members(shard, member, content)`` as one tar a shard; ``(name, pairs, bytes)`` of what was written.

    A shard's members come sorted by name, so images and truths of a stem keep their order, and
    are streamed: a task holds one Arrow batch. A tar gets its name only once it is whole and
    its members were counted again; a task that is repeated writes the same tar. The rows are
    the shards' manifest entries (``pairs`` is half the members) and have to be kept, not read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, m, c) for batch in batches for s, m, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            system, base = pa_fs.FileSystem.from_uri(folder)
            system.create_dir(base)
            part, sent = f"{base}/.{shard}.{uuid.uuid4().hex}", 0
            with system.open_output_stream(part) as sink, tarfile.open(fileobj=sink, mode="w|") as archive:
                for _, member, content in own:
                    info = tarfile.TarInfo(member)
                    info.size = len(content)
                    archive.addfile(info, io.BytesIO(content))
                    sent += 1
            with system.open_input_file(part) as stream, tarfile.open(fileobj=stream, mode="r|") as archive:
                found = sum(1 for _ in archive)
            if found != sent:
                raise RuntimeError(f"{shard}: {found} members of {sent} were written")
            system.move(part, f"{base}/{shard}")
            yield _row(name=shard, pairs=sent // 2, bytes=system.get_file_info(f"{base}/{shard}").size)

    placed = members.select("shard", "member", "content").repartition("shard").sortWithinPartitions("shard", "member")
    return placed.mapInArrow(run, "name string, pairs bigint, bytes bigint")


def font_files(spark: SparkSession, folder: str, least: int = 5) -> DataFrame:
    """Files below a folder that begin like a font; fewer than ``least`` is only a warning column, none an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    magic = F.hex(F.substring("content", 1, 4))
    # The first bytes of TrueType, OpenType and collection files.
    fonts = files.where(magic.isin("00010000", "4F54544F", "74727565", "74746366")).select("path", "length")
    n = fonts.count()
    if n == 0:
        raise ValueError(f"no fonts in {folder}")
    return fonts.withColumn("few", F.lit(n < least))


def read_pairs(spark: SparkSession, path: str, image: str = "image", truth: str = "mask") -> DataFrame:
    """``(image, truth)`` bytes of Parquet pairs whose cells are binary or ``struct<bytes, path>``."""
    rows = spark.read.parquet(path)
    kinds = dict(rows.dtypes)

    def cell(name: str):
        return F.col(f"{name}.bytes") if kinds[name].startswith("struct") else F.col(name)

    return rows.select(cell(image).alias("image"), cell(truth).alias("truth"))


def write_shards(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard; the committer's marker appears only after all were written."""
    placed.repartition(F.col(shard)).write.mode("overwrite").partitionBy(shard).parquet(path)


def verify_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``(shard, pairs, found)`` where a written shard differs from its manifest row."""
    found = spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("found"))
    return manifest.select("shard", "pairs").join(found, "shard", "full_outer").where(~F.col("pairs").eqNullSafe(F.col("found")))
