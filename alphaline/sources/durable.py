"""Versioned tables: staged writes, audits, and a pointer that moves only after the audit.

A table is a folder with ``data/`` (one folder for each write, never changed) and ``pointers/``
(numbered files, each the state after one publication). The highest number is the current state. A
publication writes its pointer aside and renames it to the next number, which fails if another writer
was there first; so readers see the state before or after, and a failed job leaves what was there.
Rolling back publishes an earlier state again. All access goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(RuntimeError):
    """An audit failed, another writer was first, or there is nothing to go back to; the table is as before."""


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def pointers(spark: SparkSession, base: str) -> list[int]:
    """The numbers of all publications, in order."""
    system, at = _system(spark, f"{base}/pointers")
    if not system.exists(at):
        return []
    return sorted(int(f.getPath().getName()) for f in system.listStatus(at) if f.getPath().getName().isdigit())


def state(spark: SparkSession, base: str, number: int | None = None) -> dict | None:
    """The current state, or that of one publication; None for a table that doesn't exist."""
    known = pointers(spark, base)
    if not known:
        return None
    text = spark.read.text(f"{base}/pointers/{known[-1] if number is None else number:012d}", wholetext=True).first()[0]
    return json.loads(text)


def publish(spark: SparkSession, base: str, after: int, content: dict) -> int:
    """Make ``content`` the state that follows publication ``after`` (0: the first)."""
    system, aside = _system(spark, f"{base}/pointers/.{uuid.uuid4().hex}")
    stream = system.create(aside)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    _, final = _system(spark, f"{base}/pointers/{after + 1:012d}")
    if system.exists(final) or not system.rename(aside, final):
        system.delete(aside, False)
        raise Refused(f"{base}: another writer published {after + 1}")
    return after + 1


def fresh(base: str) -> str:
    """A folder for one write."""
    return f"{base}/data/{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    system, at = _system(spark, path)
    system.delete(at, True)


def read(spark: SparkSession, base: str) -> DataFrame | None:
    """The current version of a merged table; None where there is none."""
    now = state(spark, base)
    return None if now is None else spark.read.parquet(now["path"])


def rollback(spark: SparkSession, base: str) -> int:
    """Publish the version before the current one again.

    Refuses where there is none, or where its data is gone.
    """
    known = pointers(spark, base)
    now = state(spark, base)
    earlier = now.get("before") if now else None
    if earlier is None:
        raise Refused(f"{base}: nothing to go back to")
    old = state(spark, base, earlier)
    system, at = _system(spark, old["path"])
    if not system.exists(at):
        raise Refused(f"{base}: the data of publication {earlier} is gone")
    return publish(spark, base, known[-1], old)


SIDES = ("im", "gt", "manifest")


def growth(old: DataFrame | None, after: DataFrame, fresh_rows: DataFrame, key: str) -> dict[str, dict[str, int]]:
    """By side: keys before, added, overwritten and after, and what the input alone lets expect to be added."""
    mark = lambda rows, name: rows.select("side", key).distinct().withColumn(name, F.lit(1))
    before = mark(old, "b") if old is not None else mark(fresh_rows.limit(0), "b")
    joined = before.join(mark(after, "a"), ["side", key], "full_outer").join(mark(fresh_rows, "n"), ["side", key], "full_outer")
    test = lambda sql: F.count_if(F.expr(sql))
    counts = joined.groupBy("side").agg(F.count("b").alias("before"), F.count("a").alias("after"), test("a = 1 AND b IS NULL").alias("added"), test("n = 1 AND b = 1").alias("overwritten"), test("n = 1 AND b IS NULL").alias("expected"), test("b = 1 AND a IS NULL").alias("lost"))
    found = {r["side"]: r.asDict() for r in counts.collect()}
    none = {"before": 0, "after": 0, "added": 0, "overwritten": 0, "expected": 0, "lost": 0}
    return {side: {k: v for k, v in found.get(side, none).items() if k != "side"} for side in SIDES}


def audit(rule: str, sides: dict[str, dict[str, int]], expected: dict[str, int] | None = None, foreign: int = 0) -> list[str]:
    """What breaks a merge's rule; nothing if it holds.

    ``replace``: the sides hold exactly the expected counts. ``add``: nothing is overwritten or lost, and
    images, truths and manifest grow alike. ``sides``: images and truths each grow by what the input
    has new, and are as many afterwards; the manifest is free. ``overwrite``: nothing is lost, no key
    outside the given set (``foreign``) is written, and no side grows by more than the input has new.
    """
    im, gt, manifest = (sides[s] for s in SIDES)
    wrong = []
    if rule == "replace":
        wrong += [f"{s}: {sides[s]['after']} of {n}" for s, n in (expected or {}).items() if sides[s]["after"] != n]
        return wrong if expected else ["replace needs the expected counts"]
    wrong += [f"{s}: {sides[s]['lost']} lost" for s in SIDES if sides[s]["lost"]]
    if rule == "add":
        wrong += [f"{s}: {sides[s]['overwritten']} overwritten" for s in ("im", "gt") if sides[s]["overwritten"]]
        if not im["added"] == gt["added"] == manifest["added"]:
            wrong.append(f"growth differs: im {im['added']}, gt {gt['added']}, manifest {manifest['added']}")
    elif rule == "sides":
        wrong += [f"{s}: grew by {sides[s]['added']}, not {sides[s]['expected']}" for s in ("im", "gt") if sides[s]["added"] != sides[s]["expected"]]
        if im["after"] != gt["after"]:
            wrong.append(f"im {im['after']} and gt {gt['after']} differ")
    elif rule == "overwrite":
        wrong += [f"{foreign} keys outside the set"] if foreign else []
        wrong += [f"{s}: grew by {sides[s]['added']} of {sides[s]['expected']}" for s in ("im", "gt") if sides[s]["added"] > sides[s]["expected"]]
    else:
        raise ValueError(f"no rule {rule}")
    return wrong


def merge(spark: SparkSession, base: str, rows: DataFrame, key: str, rule: str, expected: dict[str, int] | None = None, allowed: DataFrame | None = None) -> dict[str, dict[str, int]]:
    """Merge ``rows(side, key, ...)`` under a rule; the growth by side, once the new version is current.

    A key of a side that comes again replaces the old row; under ``replace`` the rows are the whole
    new version. The version is written first and audited as read back; if the audit fails, it is
    removed, the table stays as it was and ``Refused`` tells why. Rows that repeat a key and side:
    one of them stays.
    """
    known = pointers(spark, base)
    now = state(spark, base)
    old = read(spark, base)
    new = rows.dropDuplicates(["side", key])
    if old is not None and rule != "replace":
        kept = old.join(new.select("side", key), ["side", key], "left_anti")
        new = kept.unionByName(new)
    path = fresh(base)
    new.write.partitionBy("side").parquet(path)
    written = spark.read.schema(new.schema).parquet(path)
    sides = growth(old, written, rows, key)
    foreign = rows.join(allowed.select(key).distinct(), key, "left_anti").count() if allowed is not None else 0
    if wrong := audit(rule, sides, expected, foreign):
        discard(spark, path)
        raise Refused("; ".join(wrong))
    try:
        publish(spark, base, known[-1] if known else 0, {"path": path, "rule": rule, "before": known[-1] if now else None})
    except Refused:
        discard(spark, path)
        raise
    return sides
