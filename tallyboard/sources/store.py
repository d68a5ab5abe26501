"""A table by season on shared storage whose changes are seen as a whole or not at all.

A change writes new folders for the seasons it touches and then one small commit record, which names the
folder of every season. Readers follow the last record, so they see the old rows until the record is
there, and a job that dies before leaves folders that nobody reads (`vacuum` removes them). The record
also holds each season's fingerprint: a change that changes nothing writes no record.

Layout: `data/<id>/<season>=...`, `ledger/<id>`, `bad/<id>` and `_commits/<number>.json`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyboard.operators import refresh
from tallyboard.schemas import RAW_SCHEDULE
from tallyboard.session import stage
from tallyboard.sources import readers

SEASON = "seasonName"
FETCHED = ("fetchedAt", "fetchedFrom")


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change began with; do the change again."""


# --- commit records --------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> dict | None:
    """The last commit record of the store under `path`, or None."""
    folder, files = _files(spark, f"{path}/_commits")
    if not files.exists(folder):
        return None
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
    if not numbers:
        return None
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{max(numbers):012d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, base: dict | None, record: dict) -> dict:
    """Make `record` the version after `base`; the record is written aside and renamed, never over another."""
    number = base["number"] + 1 if base else 1
    record = {**record, "number": number}
    jvm = spark._jvm
    target, files = _files(spark, f"{path}/_commits/{number:012d}.json")
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/.{uuid.uuid4().hex}")
    stream = files.create(aside, False)
    try:
        stream.write(json.dumps(record).encode())
    finally:
        stream.close()
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(target), none)
    except Exception as error:
        files.delete(aside, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"version {number} of {path} is there already") from error
        raise
    return record


# --- reading and writing versions -------------------------------------------------


def _of_seasons(names: Sequence[str | None]) -> Column:
    """Rows of these seasons; None is the season of rows without one."""
    known = F.col(SEASON).isin([n for n in names if n is not None])
    missing = F.col(SEASON).isNull()
    return F.coalesce(known, F.lit(False)) | missing if None in names else F.coalesce(known, F.lit(False))


def read(spark: SparkSession, path: str, version: dict | None = None) -> DataFrame | None:
    """The rows of a version, by default the last one; None if nothing was committed yet."""
    version = version or latest(spark, path)
    if version is None:
        return None
    schema = StructType.fromJson(version["schema"])
    folders: dict[str, list] = {}
    for entry in version["seasons"]:
        folders.setdefault(entry["folder"], []).append(entry["season"])
    out = spark.createDataFrame([], schema)
    for folder, names in folders.items():
        part = spark.read.schema(schema).parquet(f"{path}/data/{folder}").where(_of_seasons(names))
        out = out.unionByName(part.select(*schema.names))
    return out


def _prints(df: DataFrame) -> dict:
    return {r[SEASON]: [r["rows"], r["total"], r["xored"]] for r in refresh.season_fingerprints(df).collect()}


def _schema(base: dict | None, df: DataFrame) -> StructType:
    """Columns of the stored table, then new ones; a column never changes its type."""
    old = StructType.fromJson(base["schema"]) if base else StructType([])
    types = {f.name: f.dataType for f in old.fields}
    changed = [f.name for f in df.schema.fields if f.name in types and types[f.name] != f.dataType]
    if changed:
        raise ValueError(f"types of stored columns would change: {changed}")
    nullable = [f for f in StructType.fromJson(df.schema.jsonValue()).fields if f.name not in types]
    for field in nullable:
        field.nullable = True
    return StructType([*old.fields, *nullable])


def _put(spark: SparkSession, path: str, base: dict | None, rows: DataFrame, seasons: Sequence, more: dict, sources: dict | None = None) -> dict:
    """Write `rows` as all rows of `seasons` and commit them, if that changes anything."""
    schema = _schema(base, rows)
    folder = uuid.uuid4().hex
    whole = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    whole.hint("rebalance", SEASON).write.partitionBy(SEASON).parquet(f"{path}/data/{folder}")
    written = spark.read.schema(schema).parquet(f"{path}/data/{folder}").select(*schema.names)
    prints = _prints(written)
    old = {e["season"]: e for e in base["seasons"]} if base else {}
    kept = [e for s, e in old.items() if s not in seasons]
    changed = False
    for season, found in prints.items():
        source = (sources or {}).get(season)
        entry = {"season": season, "folder": folder, "fingerprint": found, "source": source}
        before = old.get(season)
        if before and before["fingerprint"] == found and before["source"] == source and len(schema) == len(base["schema"]["fields"]):
            entry = before
        changed |= entry is not before
        kept.append(entry)
    changed |= any(s in old and s not in prints for s in seasons)
    if not changed and not any(more.get(k) != base.get(k) for k in more):
        return base
    record = {"schema": schema.jsonValue(), "ledger": [], "bad": [], **(base or {}), **more, "seasons": kept}
    record["schema"] = schema.jsonValue()
    return commit(spark, path, base, record)


def _names(df: DataFrame) -> list:
    """Season names; as many as there are seasons, however many games."""
    return [r[0] for r in df.select(SEASON).distinct().collect()]


def _latest_rows(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row a game: the last by `order`, of equal ones that of the largest hash."""
    by = [F.col(key), *[F.when(F.col(key).isNull(), F.col(c)).alias(f"_{c}") for c in refresh.identity(rows, key)]]
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*rows.columns))
    best = F.max_by(F.struct(*rows.columns), rank).alias("_row")
    return rows.groupBy(*by).agg(best).select("_row.*")


def upsert(spark: SparkSession, path: str, fresh: DataFrame, key: str = "gameId", order: Sequence[str] = (), **more) -> dict:
    """Put refetched games in the place of their stored rows; only the seasons concerned are written.

    Games without an id are told apart by day and teams. With `order`, a fresh row that is older than
    the stored one changes nothing. A game that has moved leaves its old season.
    """
    base = latest(spark, path)
    fresh = stage(_latest_rows(fresh, key, order), "fresh")
    stored = read(spark, path, base)
    if stored is None:
        return _put(spark, path, base, fresh, _names(fresh), more)
    if order:
        newer = stored.select(key, *refresh.identity(stored, key), F.struct(*order).alias("_have"))
        fresh = stage(refresh.without_matches(fresh, newer, key, F.struct(*[F.col(f"_left.{c}") for c in order]) < F.col("_right._have")), "fresh")
    seasons = _names(fresh.select(SEASON).union(refresh.with_matches(stored, fresh, key).select(SEASON)))
    if not seasons:
        return _put(spark, path, base, fresh, [], more)
    merged = refresh.upsert_games(stored.where(_of_seasons(seasons)), fresh, key)
    return _put(spark, path, base, merged, seasons, more)


def replace_seasons(spark: SparkSession, path: str, rows: DataFrame, seasons: Sequence, sources: dict | None = None) -> dict:
    """Make `rows` all rows of `seasons`; `sources` says for each what it was derived from."""
    return _put(spark, path, latest(spark, path), rows, list(seasons), {}, sources)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders that the last version doesn't name. Not while another job reads or writes the store."""
    version = latest(spark, path) or {"seasons": [], "ledger": [], "bad": []}
    named = {"data": {e["folder"] for e in version["seasons"]}, "ledger": set(version["ledger"]), "bad": set(version["bad"])}
    gone = []
    for kind, kept in named.items():
        folder, files = _files(spark, f"{path}/{kind}")
        if files.exists(folder):
            for status in files.listStatus(folder):
                if status.getPath().getName() not in kept:
                    files.delete(status.getPath(), True)
                    gone.append(f"{kind}/{status.getPath().getName()}")
    return sorted(gone)


# --- a growing folder of landed documents ------------------------------------------

_LEDGER = "file string, modified timestamp, size long, bad_documents long"
_BAD = "file string, modified timestamp, document string"


def _parts(spark: SparkSession, path: str, kind: str, version: dict | None, schema: str) -> DataFrame:
    folders = [f"{path}/{kind}/{f}" for f in (version or {}).get(kind, [])]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, size, bad_documents: every file that has been loaded."""
    return _parts(spark, path, "ledger", latest(spark, path), _LEDGER)


def bad_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, document: what could not be read as a schedule."""
    return _parts(spark, path, "bad", latest(spark, path), _BAD)


def load_landed(spark: SparkSession, landing: str, path: str, whole_files: bool = False) -> dict | None:
    """Load the schedule documents that have landed since the last load into the store under `path`.

    A file is new if the ledger doesn't have it with its time and size; the listing alone tells. Of several
    fetches of a game the one of the latest file counts, also over stored ones. Documents are lines, or whole
    files; those that aren't schedules are kept aside with their file, and the rest of the file counts. Rows, ledger and
    what is kept aside are committed at once.
    """
    base = latest(spark, path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing).select(
        F.col("path"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"),
    )
    seen = _parts(spark, path, "ledger", base, _LEDGER)
    new = stage(listed.join(seen, ["file", "modified", "size"], "left_anti"), "new-files")
    # As Spark's own scans, this holds the names of the files to be read in the driver.
    paths = [r["path"] for r in new.select("path").toLocalIterator()]
    if not paths:
        return base
    text = spark.read.option("wholetext", whole_files).text(paths).where("trim(value) <> ''")
    schema = StructType([*RAW_SCHEDULE.fields]).add("_broken", "string")
    parsed = text.select(
        F.col("_metadata.file_path").alias(FETCHED[1]), F.col("_metadata.file_modification_time").alias(FETCHED[0]),
        F.col("value"), F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken"}).alias("d"),
    ).select("*", "d.*")
    parsed = stage(parsed.drop("d"), "documents")
    bad = parsed.where("_broken IS NOT NULL OR gameWeek IS NULL")
    part = uuid.uuid4().hex
    bad.select(F.col(FETCHED[1]).alias("file"), F.col(FETCHED[0]).alias("modified"), F.col("value").alias("document")).write.parquet(f"{path}/bad/{part}")
    counts = bad.groupBy(F.col(FETCHED[1]).alias("file")).agg(F.count(F.lit(1)).alias("bad_documents"))
    told = new.join(counts, "file", "left").select("file", "modified", "size", F.coalesce("bad_documents", F.lit(0)).cast("long").alias("bad_documents"))
    told.write.parquet(f"{path}/ledger/{part}")
    games = readers.flatten_schedule(parsed.where("_broken IS NULL AND gameWeek IS NOT NULL"), keep=FETCHED)
    before = base or {}
    return upsert(
        spark, path, games, order=FETCHED,
        ledger=[*before.get("ledger", []), part], bad=[*before.get("bad", []), part],
    )
