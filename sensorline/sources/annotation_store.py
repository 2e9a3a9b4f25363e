"""A versioned store of annotations and a store of confirmed profiles, in any folder that Spark reaches.

A change is merged with the version that was read, written with its log to a folder of its own, and comes into force when a small
file that names that folder is created as exactly the next version. Only one of several writers can create it; the others read
what is new and merge again, so nobody's rows are lost. A writer that dies leaves a folder that no version names: neither its rows
nor its log are seen. Versions never change, so a snapshot is a name for one.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotations import KEY, diff_snapshots, normalise, upsert, validate

RECORD = (
    "scope string, episode_key string, id bigint, start_s double, end_s double, source string, confidence string, label string, "
    "atomic_action string, interacting_hand string, target_object_class string, is_noise boolean, cleaning_reason string"
)
HISTORY = 200
#: How often a writer merges anew because others were first.
MOST_TRIES = 50


class _Folder:
    """Small files and listings through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.paths(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        path = self.paths(f"{self.root}/{below}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.paths(f"{self.root}/{name}"))

    def _hidden(self, name: str, text: str):
        """A finished file that is not seen yet, beside the one of that name."""
        final = self.paths(f"{self.root}/{name}")
        self.fs.mkdirs(final.getParent())
        hidden = self.paths(f"{self.root}/{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self.fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        return hidden, final

    def create(self, name: str, text: str) -> bool:
        """Make a whole file at once, unless there is one: then nothing changes and the answer is no."""
        hidden, final = self._hidden(name, text)
        try:
            if self.fs.getScheme() == "file":  # a local rename would replace it
                try:
                    os.link(hidden.toUri().getPath(), final.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self.fs.exists(final) and bool(self.fs.rename(hidden, final))
        finally:
            self.fs.delete(hidden, False)

    def write(self, name: str, text: str) -> None:
        hidden, final = self._hidden(name, text)
        if self.fs.exists(final):
            self.fs.delete(final, False)
        self.fs.rename(hidden, final)

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect())


class AnnotationStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, _Folder(spark, root)

    def versions(self) -> list[int]:
        """Versions, oldest first."""
        return [int(m[1]) for n in self.folder.names("versions") if (m := re.fullmatch(r"v(\d{9})\.json", n))]

    def _version(self, number: int) -> dict:
        return json.loads(self.folder.read(f"versions/v{number:09d}.json"))

    def load(self, version: int | None = None, scope: str | None = None, episode_key: str | None = None) -> DataFrame:
        """The records of a version, the newest without one."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return self.spark.createDataFrame([], RECORD)
        frame = self.spark.read.schema(RECORD).parquet(f"{self.folder.root}/{self._version(version)['folder']}/records")
        if scope:
            frame = frame.where(F.col("scope") == scope)
        return frame.where(F.col("episode_key") == episode_key) if episode_key else frame

    def _commit(self, merge: Callable[[DataFrame], tuple[DataFrame, DataFrame, dict] | dict]) -> dict:
        """Write what merge(stored) makes of the newest version, (records, log, result), as the next one; if another writer was
        first, merge anew. A plain result writes nothing."""
        for _ in range(MOST_TRIES):
            base = max(self.versions(), default=0)
            made = merge(self.load(base))
            if isinstance(made, dict):
                return made
            table, log, result = made
            folder, number = f"data/{uuid.uuid4().hex}", base + 1
            table.write.parquet(f"{self.folder.root}/{folder}/records")
            log = log.withColumn("version", F.lit(number)).withColumn("at", F.current_timestamp())
            log.write.parquet(f"{self.folder.root}/{folder}/log")
            n = self.spark.read.parquet(f"{self.folder.root}/{folder}/log").count()
            if self.folder.create(f"versions/v{number:09d}.json", json.dumps({"folder": folder, "changes": n})):
                return result | {"version": number}
            self.folder.fs.delete(self.folder.paths(f"{self.folder.root}/{folder}"), True)
        raise RuntimeError(f"other writers were first {MOST_TRIES} times")

    def save(self, records: DataFrame, order: str = "nth", episodes: DataFrame | None = None, dry_run: bool = False) -> dict:
        """Add or change records by (scope, episode_key, id): counts by action, or the errors that stopped it.

        Records with errors, ids twice in one batch and, if episodes (episode_key) are given, unknown episodes are errors;
        nothing is written then. Missing columns are null.
        """
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = dict(c.split() for c in RECORD.split(", "))
        records = normalise(records)
        shaped = records.select(*[(F.col(c) if c in records.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
        shaped = shaped.withColumn(order, F.monotonically_increasing_id())
        wrong = validate(shaped).where(F.size("errors") > 0).select(*KEY, "errors")
        twice = shaped.groupBy(*KEY).count().where("count > 1").select(*KEY, F.array(F.lit("duplicate")).alias("errors"))
        wrong = wrong.union(twice)
        if episodes is not None:
            wrong = wrong.union(shaped.join(episodes.select("episode_key"), "episode_key", "left_anti").select(*KEY, F.array(F.lit("unknown_episode")).alias("errors")))
        found = [r.asDict() for r in wrong.limit(50).collect()]
        if found:
            return {"success": False, "error": "invalid_records", "errors": found}
        def merge(stored: DataFrame):
            table, log = upsert(stored, shaped, order)
            counts = {r.action: r["count"] for r in log.groupBy("action").count().collect()}
            result = {"success": True, "version": None, **{a: counts.get(a, 0) for a in ("added", "modified", "skipped")}}
            return result if dry_run or not set(counts) - {"skipped"} else (table, log.where("action <> 'skipped'"), result)

        return self._commit(merge)

    def delete(self, keys: DataFrame) -> dict:
        """Remove records by (scope, episode_key, id)."""
        keys = keys.select(*KEY).distinct()

        def merge(stored: DataFrame):
            gone = stored.join(keys, KEY, "left_semi").select(*KEY, F.lit("removed").alias("action"))
            n = gone.count()
            return (stored.join(keys, KEY, "left_anti"), gone, {"success": True, "removed": n}) if n else {"success": False, "error": "not_found", "removed": 0}

        return self._commit(merge)

    def history(self, most: int = HISTORY) -> DataFrame:
        """The newest changes: version, at, key and action. Only the logs of as many versions as it takes are read."""
        logs, n = [], 0
        for version in reversed(self.versions()):
            told = self._version(version)
            logs.append(f"{self.folder.root}/{told['folder']}/log")
            if (n := n + told["changes"]) >= most:
                break
        shape = "scope string, episode_key string, id bigint, action string, version int, at timestamp"
        if not logs:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*logs).orderBy(F.desc("version"), *KEY).limit(most)

    def snapshot(self, name: str) -> dict:
        """Name the newest version."""
        if not re.fullmatch(r"[\w.-]{1,80}", name):
            return {"success": False, "error": "invalid_name"}
        if self.folder.exists(f"snapshots/{name}.json"):
            return {"success": False, "error": "snapshot_exists"}
        version = max(self.versions(), default=0)
        if not version:
            return {"success": False, "error": "empty_store"}
        if not self.folder.create(f"snapshots/{name}.json", json.dumps({"name": name, "version": version, "records": self.load(version).count()})):
            return {"success": False, "error": "snapshot_exists"}
        return {"success": True, "name": name, "version": version}

    def snapshots(self) -> list[dict]:
        return [json.loads(self.folder.read(f"snapshots/{n}")) for n in self.folder.names("snapshots") if n.endswith(".json")]

    def diff(self, old: str, new: str) -> DataFrame:
        """Differences of two snapshots by name."""
        at = {s["name"]: s["version"] for s in self.snapshots()}
        return diff_snapshots(self.load(at[old]), self.load(at[new]), KEY)


class ProfileStore:
    """What users have confirmed about a dataset: kinds by table name, and columns that may lack values by glob."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = _Folder(spark, root)

    def load(self, dataset: str) -> dict:
        text = self.folder.read(f"{_safe(dataset)}.json")
        return json.loads(text) if text else {"kinds": {}, "expected_missing": {}, "capabilities": {}}

    def save(self, dataset: str, **changes: dict) -> dict:
        profile = self.load(dataset)
        for part, values in changes.items():
            profile.setdefault(part, {}).update(values)
        self.folder.write(f"{_safe(dataset)}.json", json.dumps(profile, sort_keys=True))
        return profile


def expected_missing(profile: dict, table: str, columns: list[str]) -> tuple[str, ...]:
    """Columns of a table that may lack values: patterns of other tables do not count."""
    patterns = [p for t, own in profile.get("expected_missing", {}).items() if fnmatch.fnmatch(table, t) for p in own]
    return tuple(c for c in columns if any(fnmatch.fnmatch(c, p) for p in patterns))


def _safe(name: str) -> str:
    """A file name of a dataset's: its last part as it can be, and a hash of the whole, so that no two share one."""
    return f"profile-{re.sub(r'[^\w.-]', '_', name.rstrip('/').rsplit('/', 1)[-1])[:60]}-{hashlib.sha1(name.encode()).hexdigest()[:16]}"
