"""The history tables: partitioned Parquet, read by date range, upserted by partition, published together.

Data folders are immutable. A commit writes the partitions it changes, of all tables, into folders of its
own and then publishes one manifest, a small file that names the folder of every partition, by a rename to
the next version number. Readers resolve the newest manifest once and see one version of all tables: a
job that stops anywhere before the rename changes nothing, and of two writers of one version the
second fails. Parquet has no MERGE, so an upsert rewrites the partitions a batch touches. Folders that
recent versions do not name are removed by `expire_versions`.

Partial statistics of each date are tables of the same commit. They are made from the rows of a partition
whenever it is written, so a corrected value leaves its date's count, sum and maximum with the old rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfold import settings
from emberfold.functions.numeric import sum_parts
from emberfold.operators.bloom import with_likely, worthwhile
from emberfold.operators.normalize import InvalidBatch
from emberfold.session import file_system, together
from emberfold.settings import (
    FIRE_CLUSTER_MEMBERS, FIRE_CLUSTERS, FIRE_DAILY_CLUSTERS, FIRE_DAILY_DETECTIONS, FIRE_DETECTIONS)


class DuplicateKeys(ValueError):
    """A batch names one row of a table twice, so what it means to write is not defined."""


class ConcurrentCommit(RuntimeError):
    """Another writer has published the version that this one was to be."""


class StorageLimit(RuntimeError):
    """The history tables are at or above the size their owner allows."""


TABLES = {
    "fire_detections": dict(
        schema=FIRE_DETECTIONS, partition="observation_date", keys=["detection_id"],
        layout=["cluster_id", "satellite"],
        update=["cluster_id", "cluster_snapshot_at", "confidence", "frp_mw", "quality_flags",
                "last_ingested_at"]),
    "fire_clusters": dict(
        schema=FIRE_CLUSTERS, partition="snapshot_date", keys=["cluster_id", "snapshot_at"],
        layout=["cluster_id", "severity"],
        update=["center", "boundary", "detection_count", "total_frp_mw",
                "maximum_frp_mw", "first_detected_at", "last_detected_at", "confidence", "trend",
                "severity", "status", "merged_into_cluster_id"]),
    "fire_cluster_members": dict(
        schema=FIRE_CLUSTER_MEMBERS, partition="snapshot_date", keys=["cluster_id", "snapshot_at", "detection_id"],
        layout=["cluster_id"], update=[]),
    "fire_daily_detections": dict(
        schema=FIRE_DAILY_DETECTIONS, partition="observation_date", keys=["satellite"], layout=[],
        source="fire_detections"),
    "fire_daily_clusters": dict(
        schema=FIRE_DAILY_CLUSTERS, partition="snapshot_date", keys=["severity", "status"], layout=[],
        source="fire_clusters"),
}


def partials(rows: DataFrame, table: str) -> DataFrame:
    """The partial statistics `table` of rows of its source."""
    spec = TABLES[table]
    exact, rest = sum_parts(F.col("frp_mw"))
    values = {
        "fire_daily_detections": [
            F.count(F.lit(1)).alias("detections"), F.count("frp_mw").alias("known_frp"),
            exact.alias("exact_frp"), rest.alias("rest_frp"), F.max("frp_mw").alias("maximum_frp_mw")],
        "fire_daily_clusters": [F.count(F.lit(1)).alias("snapshot_count")],
    }[table]
    return rows.groupBy(*spec["keys"], spec["partition"]).agg(*values).select(*[f.name for f in spec["schema"]])


MANIFESTS = "_versions"
#: Versions whose folders stay when others are removed: readers that began on them can finish.
KEPT_VERSIONS = 3

#: version, and for each table the folder (below the table's) of each date
Manifest = dict


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = file_system(spark, path)
    return fs.exists(jvm_path)


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = file_system(spark, _path(root, MANIFESTS))
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The manifest of a version, by default the newest; an empty one where nothing was published."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return {"version": 0, "tables": {t: {} for t in TABLES}}
        version = known[-1]
    fs, path = file_system(spark, f"{_path(root, MANIFESTS)}/{version:012d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, manifest: Manifest) -> None:
    folder = _path(root, MANIFESTS)
    fs, aside = file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    _, target = file_system(spark, f"{folder}/{manifest['version']:012d}.json")
    stream = fs.create(aside)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise ConcurrentCommit(f"version {manifest['version']} is already published")


def read_history(
    spark: SparkSession, root: str, table: str, start: date, end: date, manifest: Manifest | None = None
) -> DataFrame:
    """One history table between two dates, both inclusive. The range is required: it prunes partitions.

    The full schema is given, so files written before a column existed read as NULL there. Reads of
    several tables that share a `manifest` see one version.
    """
    if not isinstance(start, date) or not isinstance(end, date):
        raise TypeError("a date range is required")
    return _read(spark, root, table, start, end, manifest or read_manifest(spark, root))


def _read(spark: SparkSession, root: str, table: str, start: date, end: date, manifest: Manifest) -> DataFrame:
    spec = TABLES[table]
    folders = [f for day, f in sorted(manifest["tables"].get(table, {}).items()) if start.isoformat() <= day <= end.isoformat()]
    if not folders:
        return spark.createDataFrame([], spec["schema"])
    path = _path(root, table)
    day = F.col(spec["partition"])
    return (
        spark.read.schema(spec["schema"]).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])
        .where((day >= F.lit(start)) & (day <= F.lit(end))).select(*[f.name for f in spec["schema"]])
    )


def read_partials(
    spark: SparkSession, root: str, table: str, start: date, end: date, manifest: Manifest | None = None
) -> DataFrame:
    """Partial statistics of the dates between two, both inclusive.

    Dates written before the table existed have no partial rows; theirs are made from their rows.
    """
    manifest = manifest or read_manifest(spark, root)
    source = TABLES[table]["source"]
    days = manifest["tables"].get(source, {})
    missing = {d: f for d, f in days.items() if d not in manifest["tables"].get(table, {})}
    known = _read(spark, root, table, start, end, manifest)
    if not any(start.isoformat() <= d <= end.isoformat() for d in missing):
        return known
    older = _read(spark, root, source, start, end, {"tables": {source: missing}})
    return known.unionByName(partials(older, table))


def merge_rows(current: DataFrame, batch: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Rows of `current` updated from `batch` on `keys`, plus the rows only `batch` has.

    Matched rows take the `update` columns from the batch, NULLs included, and keep all others.
    """
    incoming = batch.select(*keys, F.struct(*batch.columns).alias("new"))
    held = current.select(*keys, F.struct(*current.columns).alias("old"))
    joined = held.join(incoming, keys, "full_outer")
    def pick(c: str):
        if c in keys:
            return F.col(c)
        choice = F.when(F.col("new").isNull(), F.col(f"old.{c}"))
        if c not in update:
            choice = choice.when(F.col("old").isNotNull(), F.col(f"old.{c}"))
        return choice.otherwise(F.col(f"new.{c}")).alias(c)
    return joined.select(*[pick(c) for c in current.columns])


def upsert(
    spark: SparkSession, root: str, batches: dict[str, DataFrame], replaced: dict[str, Column] | None = None
) -> None:
    """Merge batches, each unique on its table's keys, into the history, as one version.

    Batches are read several times, so pass written tables. A detection keeps its partition for life (the
    date is part of its identity), and so does a snapshot row, so only partitions named by the batch can
    hold a match. `replaced` marks, by key columns, held rows of a table that go, whether a batch row matches them
    or not. Where it marks all rows of the batch too, what stays cannot match them, and they are added as they are.
    """
    manifest = read_manifest(spark, root)
    replaced = replaced or {}
    changes = {}

    def state_of(table: str):
        spec = TABLES[table]
        partition = spec["partition"]
        return batches[table].groupBy(*spec["keys"], partition).agg(F.count(F.lit(1)).alias("n")).agg(
            F.max("n").alias("most"), F.sum("n").alias("rows"), F.min(partition).alias("start"),
            F.max(partition).alias("end"),
            F.bool_and(F.coalesce(replaced[table], F.lit(False)) if table in replaced else F.lit(False)).alias("renewed")).first()

    states = together(spark, *[lambda table=table: state_of(table) for table in batches])
    for (table, batch), state in zip(batches.items(), states):
        spec = TABLES[table]
        partition = spec["partition"]
        columns = [f.name for f in spec["schema"]]
        batch = batch.select(*columns)
        if state.most is None:
            continue
        if state.most > 1:
            raise DuplicateKeys(f"a batch for {table} must be unique on {', '.join(spec['keys'])}")
        # Distinct partition dates: bounded by the retention, a few in practice.
        days = batch.select(partition).distinct()
        current = _read(spark, root, table, state.start, state.end, manifest).join(
            F.broadcast(days), partition, "left_semi").select(*columns)
        if table in replaced:
            current = current.where(~replaced[table])
        if state.renewed:
            changes[table] = current.unionByName(batch)
            continue
        keys = [*spec["keys"], partition]
        if state.rows <= settings.BROADCAST_ROWS or not worthwhile(state.rows):
            changes[table] = merge_rows(current, batch, keys, spec["update"]).select(*columns)
            continue
        # Of a large batch only rows that a Bloom filter lets through are shuffled to the merge.
        current = with_likely(current, batch, keys, state.rows)
        merged = merge_rows(current.where("_likely").drop("_likely"), batch, keys, spec["update"])
        changes[table] = merged.select(*columns).unionByName(current.where("NOT _likely").select(*columns))
    commit(spark, root, changes, manifest)


def commit(
    spark: SparkSession, root: str, changes: dict[str, DataFrame], manifest: Manifest | None = None,
    dropped: Callable[[str, date], bool] = lambda table, day: False,
) -> Manifest:
    """Replace the partitions present in `changes`, and leave out those `dropped`, as the version after `manifest`."""
    manifest = manifest or read_manifest(spark, root)
    tables = {t: {d: f for d, f in manifest["tables"].get(t, {}).items()
                  if not dropped(spec.get("source", t), date.fromisoformat(d))} for t, spec in TABLES.items()}

    def write(table: str) -> None:
        tables[table] |= (fresh := _write_folder(spark, root, table, changes[table]))
        for partial in (p for p, spec in TABLES.items() if spec.get("source") == table and fresh):
            first, last = date.fromisoformat(min(fresh)), date.fromisoformat(max(fresh))
            again = _read(spark, root, table, first, last, {"tables": {table: fresh}})
            tables[partial] |= _write_folder(spark, root, partial, partials(again, partial))

    if changes:
        together(spark, *[lambda table=table: write(table) for table in changes])
    following = {"version": manifest["version"] + 1, "tables": tables}
    _publish(spark, root, following)
    return following


def _write_folder(spark: SparkSession, root: str, table: str, rows: DataFrame) -> dict[str, str]:
    """Write rows to a folder of their own; the folder of each of their dates."""
    folder, partition = f"commit={uuid.uuid4().hex}", TABLES[table]["partition"]
    path = f"{_path(root, table)}/{folder}"
    write_partitions(rows, path, table)
    return {day.isoformat(): f"{folder}/{partition}={day.isoformat()}" for day in _dates(spark, path, partition)}


def write_partitions(df: DataFrame, path: str, table: str) -> None:
    """Write whole partitions to a new folder, ranged and sorted by the table's layout columns.

    Ranges over (date, layout) split a large date over many files whose statistics let a read by
    cluster skip most of them. The row key comes last, so a cluster holding a large share of the
    rows still spreads over many tasks.
    """
    spec = TABLES[table]
    partition = spec["partition"]
    order = [partition, *spec["layout"], *[k for k in spec["keys"] if k not in spec["layout"]]]
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("errorifexists").partitionBy(partition).parquet(path)
    )


def _dates(spark: SparkSession, path: str, partition: str) -> list[date]:
    fs, jvm_path = file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(jvm_path)] if fs.exists(jvm_path) else []
    return sorted(date.fromisoformat(n[len(partition) + 1:]) for n in names if n.startswith(f"{partition}="))


def partitions(spark: SparkSession, root: str, table: str) -> list[date]:
    """Dates that have a partition, from the manifest alone."""
    return sorted(map(date.fromisoformat, read_manifest(spark, root)["tables"][table]))


def expired_partitions(
    spark: SparkSession, root: str, table: str, now: date, days: int = settings.RETENTION_DAYS
) -> list[date]:
    return [d for d in partitions(spark, root, table) if d < now - timedelta(days=days)]


def expire_partitions(
    spark: SparkSession, root: str, table: str, now: date,
    days: int = settings.RETENTION_DAYS, dry_run: bool = True,
) -> list[date]:
    """Drop partitions older than the retention from the next version; by default only lists them."""
    old = expired_partitions(spark, root, table, now, days)
    if old and not dry_run:
        commit(spark, root, {}, dropped=lambda t, day: t == table and day in old)
    return old


def expire_versions(spark: SparkSession, root: str, keep: int = KEPT_VERSIONS) -> list[str]:
    """Remove all manifests but the last `keep`, and the folders that only older versions, or stopped jobs, name.

    Not to be run beside a writer, whose folders no manifest names yet. Returns the folders removed.
    """
    known = versions(spark, root)
    kept = [read_manifest(spark, root, v) for v in known[-keep:]]
    removed = []
    for table in TABLES:
        fs, path = file_system(spark, _path(root, table))
        named = {f for m in kept for f in m["tables"].get(table, {}).values()}
        for commit_folder in fs.listStatus(path) if fs.exists(path) else []:
            inside = [s.getPath() for s in fs.listStatus(commit_folder.getPath())]
            held = {f"{commit_folder.getPath().getName()}/{p.getName()}": p for p in inside}
            dead = {name: p for name, p in held.items() if name not in named}
            if not named.intersection(held):
                dead = {commit_folder.getPath().getName(): commit_folder.getPath()}
            for name, p in dead.items():
                fs.delete(p, True)
                removed.append(f"{table}/{name}")
    for version in known[:-keep]:
        fs, path = file_system(spark, f"{_path(root, MANIFESTS)}/{version:012d}.json")
        fs.delete(path, False)
    return removed


def storage_bytes(spark: SparkSession, root: str) -> int:
    """Bytes held by the tables, from file metadata."""
    total = 0
    for table in TABLES:
        fs, path = file_system(spark, _path(root, table))
        if fs.exists(path):
            total += fs.getContentSummary(path).getLength()
    return total


def check_storage(spark: SparkSession, root: str, limit: int | None = settings.STORAGE_GUARD_BYTES) -> None:
    if limit is not None and storage_bytes(spark, root) >= limit:
        raise StorageLimit("the history tables reached their size limit")


def relationship_violations(detections: DataFrame, clusters: DataFrame) -> DataFrame:
    """(violation, key) for duplicate keys and orphan references of a batch; must be empty."""
    def repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return (
            df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select(F.lit(name).alias("violation"), F.col(keys[0]).alias("key"))
        )
    known = clusters.select("cluster_id", F.col("snapshot_at").alias("cluster_snapshot_at")).distinct()
    # Many detections share a cluster: reduce to distinct references before looking for orphans.
    references = detections.select("cluster_id", "cluster_snapshot_at").distinct()
    orphans = references.join(known, ["cluster_id", "cluster_snapshot_at"], "left_anti").select(
        F.lit("orphan_cluster_reference").alias("violation"), F.col("cluster_id").alias("key"))
    return (
        repeated(clusters, ["cluster_id", "snapshot_at"], "duplicate_cluster_snapshot")
        .unionByName(repeated(detections, ["detection_id"], "duplicate_detection"))
        .unionByName(orphans)
    )


def check_relationships(detections: DataFrame, clusters: DataFrame) -> None:
    broken = relationship_violations(detections, clusters).limit(5).collect()
    if broken:
        raise InvalidBatch("; ".join(f"{r.violation}: {r.key}" for r in broken))


# --- JSON interchange ---------------------------------------------------------------------------

PAGE_ROWS = 1_000


def encode_json_pages(df: DataFrame, key: str, rows: int, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(page, payload): JSON arrays of about `page_rows` rows each, spread by a hash of `key`.

    `rows` is the known row count. Times print in UTC with a Z.
    """
    pages = max(1, -(-rows // page_rows))
    record = F.struct(*[
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if t == "timestamp" else F.col(c)
        for c, t in df.dtypes])
    return (
        df.select(F.pmod(F.xxhash64(key), F.lit(pages)).alias("page"), record.alias("record"))
        .groupBy("page")
        .agg(F.to_json(F.collect_list("record"), {"ignoreNullFields": "false"}).alias("payload"))
    )


def decode_json_pages(pages: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows of JSON array payloads."""
    parsed = F.from_json("payload", T.ArrayType(schema), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssX"})
    return pages.select(F.inline(parsed))
