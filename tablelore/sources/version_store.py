"""Snapshots and drift reports on disk: a log of manifests a source, and Parquet files a snapshot.

  <folder>/<md5 of the source key>/data/<snapshot id>/{tables,columns,drift}
  <folder>/<md5 of the source key>/log/<number>.json            one line: the snapshot, where its files are, and the same of the one before
  <folder>/<md5 of the source key>/packed/<number>/{headers,tables,columns,drift}   all snapshots up to a number, in few files
  <folder>/<md5 of the source key>/log/<number>.packed          written when these are complete

A manifest is written last, so what a lost job leaves behind is never seen. Its number is one above the number before, and the file must not exist yet:
of two writers that start from the same snapshot the second is refused. That needs a file system that creates files exclusively, as HDFS does. A new
snapshot is compared with the one its manifest points back to: two snapshots are read, however long the history is.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelore.operators import versions

# Columns of the stored frames and of the reports.
SCHEMAS = {
    "headers": "snapshot_id string, source_path string, captured_at timestamp_ntz, source_key string, schema_hash string, previous_id string, number long",
    "tables": "snapshot_id string, table_name string, column_count bigint, row_count bigint, completeness_score double, table_digest string",
    "columns": "snapshot_id string, table_name string, column_name string",
    "drift": "snapshot_id_before string, snapshot_id_after string, source_path string, captured_at timestamp_ntz, "
             "tables_added array<string>, tables_removed array<string>, columns_added map<string,array<string>>, "
             "columns_removed map<string,array<string>>, "
             "completeness_changes map<string,struct<before:double,after:double,delta:double>>, "
             "row_count_changes map<string,struct<before:bigint,after:bigint,delta_pct:double>>, "
             "has_breaking_changes boolean, summary string, source_key string",
}
ID = {"headers": "snapshot_id", "tables": "snapshot_id", "columns": "snapshot_id", "drift": "snapshot_id_after"}


class WriteConflict(RuntimeError):
    """Another writer has stored a snapshot of this source in the meantime."""


class VersionStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    # ---- files ---------------------------------------------------------------------------------------------------

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _create(self, path: str, text: str) -> None:
        """A new file; fails if there is one of this name."""
        p, fs = self._path(path)
        try:
            out = fs.create(p, False)
        except Exception as e:  # noqa: BLE001  Py4J wraps what the file system raises
            if fs.exists(p):
                raise WriteConflict(f"{path} is there already") from e
            raise
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def _read_text(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _key(self, source_path: str) -> str:
        return self.spark.range(1).select(versions.source_key(F.lit(source_path)).alias("k")).first().k

    def _home(self, source_key: str) -> str:
        return f"{self.folder}/{hashlib.md5(source_key.encode()).hexdigest()}"

    # ---- the log -------------------------------------------------------------------------------------------------

    def _log(self, home: str) -> tuple[list[int], int]:
        """Numbers of the manifests, and the number all up to which are packed (-1 if none are)."""
        names = self._names(f"{home}/log")
        packed = [int(n[:-len(".packed")]) for n in names if n.endswith(".packed")]
        return [int(n[:-len(".json")]) for n in names if n.endswith(".json")], max(packed, default=-1)

    def _manifest(self, home: str, number: int) -> dict:
        return json.loads(self._read_text(f"{home}/log/{number:012d}.json"))

    def _newest(self, home: str) -> dict | None:
        numbers, _ = self._log(home)
        return self._manifest(home, numbers[-1]) if numbers else None

    def _publish(self, home: str, head: dict, previous: dict | None) -> dict:
        entry = {**head, "number": previous["number"] + 1 if previous else 0, "data": f"data/{head['snapshot_id']}",
                 "previous": {k: previous[k] for k in ("number", "snapshot_id", "data", "source_path", "captured_at")} if previous else None}
        try:
            self._create(f"{home}/log/{entry['number']:012d}.json", json.dumps(entry))
        except WriteConflict as e:
            raise WriteConflict(f"another snapshot of {head['source_path']} was stored at the same time; take this one again") from e
        return entry

    # ---- reading -------------------------------------------------------------------------------------------------

    def _parquet(self, name: str, *paths: str) -> DataFrame:
        have = [p for p in paths if self._path(p)[1].exists(self._path(p)[0])]
        if not have:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*have)

    def _headers(self, home: str) -> DataFrame:
        """Every stored snapshot: those packed, and the manifests after them."""
        numbers, packed = self._log(home)
        out = self._parquet("headers", f"{home}/packed/{packed:012d}/headers")
        late = [f"{home}/log/{n:012d}.json" for n in numbers if n > packed]
        if not late:
            return out
        fields = SCHEMAS["headers"].replace("previous_id string", "previous struct<snapshot_id: string>")
        read = self.spark.read.schema(fields).json(late).withColumn("previous_id", F.col("previous.snapshot_id"))
        return out.unionByName(read.select(out.columns))

    def _homes(self, source_path: str | None) -> list[str]:
        if source_path is not None:
            return [self._home(self._key(source_path))]
        return [f"{self.folder}/{n}" for n in self._names(self.folder)]

    def read(self, name: str, source_path: str | None = None) -> DataFrame:
        """A stored frame, of one source or of all; only that source's folder is touched. Empty when nothing is there."""
        frames = []
        for home in self._homes(source_path):
            if name == "headers":
                frames.append(self._headers(home))
                continue
            numbers, packed = self._log(home)
            late = [self._manifest(home, n) for n in numbers if n > packed]
            frames.append(self._parquet(name, f"{home}/packed/{packed:012d}/{name}", *(f"{home}/{e['data']}/{name}" for e in late)))
        out = self.spark.createDataFrame([], SCHEMAS[name])
        for f in frames:
            out = out.unionByName(f)
        return out

    def snapshots(self, source_path: str) -> DataFrame:
        return self.read("headers", source_path).orderBy("captured_at", "number")

    def latest_snapshot(self, source_path: str) -> DataFrame:
        return versions.latest(self.read("headers", source_path))

    def drift_history(self, source_path: str) -> DataFrame:
        return self.read("drift", source_path).orderBy("captured_at")

    def all_drift(self, source_path: str | None = None) -> DataFrame:
        """Drift between all consecutive snapshots, worked out from the history."""
        return versions.drift(self.read("headers", source_path), self.read("tables", source_path), self.read("columns", source_path))

    # ---- writing -------------------------------------------------------------------------------------------------

    def _write_parts(self, parts: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[str, dict, dict | None]:
        """The files of a snapshot, not published yet, and the manifest it follows."""
        head, tables, columns = parts
        row = head.first()
        home = self._home(row.source_key)
        previous = self._newest(home)
        entry = {"snapshot_id": row.snapshot_id, "source_path": row.source_path, "source_key": row.source_key,
                 "captured_at": row.captured_at.isoformat(), "schema_hash": row.schema_hash}
        tables.coalesce(1).write.parquet(f"{home}/data/{row.snapshot_id}/tables")
        columns.write.parquet(f"{home}/data/{row.snapshot_id}/columns")
        return home, entry, previous

    def save(self, parts: tuple[DataFrame, DataFrame, DataFrame]) -> None:
        """Store a snapshot. Raises WriteConflict if another was stored since this call began."""
        self._publish(*self._write_parts(parts))

    def compared(self, home: str, entry: dict, previous: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Headers, tables and columns of a snapshot and the one before it; nothing else is read."""
        rows = [(e["snapshot_id"], e["source_path"], entry["source_key"], e["captured_at"]) for e in (previous, entry)]
        headers = self.spark.createDataFrame(rows, "snapshot_id string, source_path string, source_key string, captured_at string")
        headers = headers.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))
        paths = [f"{home}/{previous['data']}", f"{home}/data/{entry['snapshot_id']}"]
        return headers, self._parquet("tables", *(f"{p}/tables" for p in paths)), self._parquet("columns", *(f"{p}/columns" for p in paths))

    def detect_drift(self, parts: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
        """Store a snapshot and report its drift against the one before; no row on the first run. The report is published with the snapshot."""
        home, entry, previous = self._write_parts(parts)
        path = f"{home}/data/{entry['snapshot_id']}/drift"
        if previous is not None:
            headers, tables, columns = self.compared(home, entry, previous)
            pair = headers.filter(F.col("snapshot_id") == entry["snapshot_id"]).select(
                F.lit(previous["snapshot_id"]).alias("snapshot_id_before"), F.col("snapshot_id").alias("snapshot_id_after"),
                "source_path", "source_key", "captured_at")
            versions.drift(headers, tables, columns, pair).coalesce(1).write.parquet(path)
        self._publish(home, entry, previous)
        return self._parquet("drift", path)

    def compact(self, source_path: str) -> None:
        """All snapshots of a source in few files. What was stored before stays until clean_up; snapshots stored meanwhile are not touched."""
        home = self._home(self._key(source_path))
        numbers, packed = self._log(home)
        if not numbers or numbers[-1] <= packed:
            return
        upto = numbers[-1]
        kept = self._headers(home).filter(F.col("number") <= upto)
        folder = f"{home}/packed/{upto:012d}"
        kept.coalesce(1).write.mode("overwrite").parquet(f"{folder}/headers")
        for name in ("tables", "columns", "drift"):
            late = [self._manifest(home, n) for n in numbers if packed < n <= upto]
            frame = self._parquet(name, f"{home}/packed/{packed:012d}/{name}", *(f"{home}/{e['data']}/{name}" for e in late))
            frame.repartition(F.col(ID[name])).write.mode("overwrite").parquet(f"{folder}/{name}")
        self._create(f"{home}/log/{upto:012d}.packed", "")

    def clean_up(self, source_path: str) -> None:
        """Removes what a later packing has replaced, and files of snapshots never published. The newest snapshot's own files stay: the next is compared with them.

        Not to be run while the source is read or written.
        """
        home = self._home(self._key(source_path))
        numbers, packed = self._log(home)
        newest = self._newest(home)
        if newest is None:
            return
        live = {self._manifest(home, n)["data"].split("/")[-1] for n in numbers if n > packed} | {newest["snapshot_id"]}
        gone = [f"{home}/data/{n}" for n in self._names(f"{home}/data") if n not in live]
        gone += [f"{home}/packed/{n}" for n in self._names(f"{home}/packed") if int(n) < packed]
        gone += [f"{home}/log/{n:012d}.json" for n in numbers if n <= packed and n != newest["number"]]
        gone += [f"{home}/log/{n}" for n in self._names(f"{home}/log") if n.endswith(".packed") and int(n[:-len(".packed")]) < packed]
        for path in gone:
            p, fs = self._path(path)
            fs.delete(p, True)
