"""Saved results as parquet tables below one root, and the reads over them.

A table is a list of folders and a version of the store names the folders of all tables. Folders are written first and never
changed; then one manifest, a small text file that lists them, makes them the next version. A reader takes the newest manifest and sees one
version of all tables, whatever is written meanwhile, and a job that ends in between leaves folders that no version names. Two
writers that start from the same version cannot both make the next one: the second is told and may try again.

Folders are partitioned by a hash bucket of the tenant: any number of tenants, a bounded number of
subfolders, and a tenant's rows in one of them. Rows are sorted by tenant (and check) inside, so row-group
statistics prune the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from wareproof.operators.history import first_of_day
from wareproof.operators.registry import checks_table
from wareproof.operators.summary import rule_counts
from wareproof.plans.scan import ScanResult
from wareproof.session import scratch_path

BUCKETS = 64
MANIFESTS = "_manifests"
SCANS = (
    "tenant string, scan_id bigint, score bigint, total bigint, clean bigint, open bigint, high bigint, "
    "full boolean, catalog_total bigint, ignored bigint, read_at timestamp, created_at timestamp"
)


def bucket(tenant: Column) -> Column:
    return F.pmod(F.xxhash64(tenant), F.lit(BUCKETS)).cast("int")


class VersionTaken(RuntimeError):
    """Another writer made the version this one was about to make."""


@dataclass(frozen=True)
class Version:
    """What a manifest says: per table its folders and the schema of their rows."""

    number: int
    folders: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Store:
    """The tables below one root."""

    spark: SparkSession
    root: str

    # ---- versions ----

    def _files(self):
        """Hadoop's file system of the root, which all executors and other writers share."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _manifest(self, number: int) -> str:
        return f"{self.root.rstrip('/')}/{MANIFESTS}/{number:012d}.json"

    def versions(self) -> list[int]:
        """The numbers of the manifests that are there."""
        files, path = self._files()
        folder = path(f"{self.root.rstrip('/')}/{MANIFESTS}")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number; a store that was never written is version 0."""
        if number is None:
            number = max(self.versions(), default=0)
        if number == 0:
            return Version(0)
        said = json.loads(self.spark.read.text(self._manifest(number), wholetext=True).first().value)
        return Version(number, said["folders"], said["schemas"])

    def _publish(self, version: Version) -> None:
        """Write the manifest beside its place and move it there; a place that is taken is left as it is."""
        files, path = self._files()
        target = path(self._manifest(version.number))
        staged = path(f"{target.getParent().toString()}/.{uuid.uuid4().hex}")
        out = files.create(staged, True)
        out.write(bytearray(json.dumps({"folders": version.folders, "schemas": version.schemas}).encode()))
        out.close()
        try:
            made = not files.exists(target) and files.rename(staged, target)
        finally:
            if files.exists(staged):
                files.delete(staged, False)
        if not made:
            raise VersionTaken(f"version {version.number} of {self.root} is there already")

    # ---- reading ----

    def read(self, table: str, tenant: str | None = None, at: Version | None = None) -> DataFrame:
        """A table, or the rows of one tenant with everything else pruned by folder, of the newest version or of the one given."""
        at = at or self.version()
        if table not in at.folders:
            raise KeyError(f"nothing was saved to {table} yet")
        schema = StructType.fromJson(at.schemas[table]).add("tenant_bucket", IntegerType())
        parts = [self.spark.read.schema(schema).option("basePath", f).parquet(f) for f in at.folders[table]]
        if not parts:
            return self.spark.createDataFrame([], StructType.fromJson(at.schemas[table]))
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part)
        if tenant is not None:
            df = df.filter((F.col("tenant_bucket") == bucket(F.lit(tenant))) & (F.col("tenant") == tenant))
        return df.drop("tenant_bucket")

    def exists(self, table: str) -> bool:
        """Whether anything was written to a table yet."""
        return table in self.version().folders

    # ---- writing ----

    def _write(self, table: str, df: DataFrame) -> str:
        folder = f"{self.root.rstrip('/')}/{table}/{uuid.uuid4().hex}"
        rows = df.withColumn("tenant_bucket", bucket(F.col("tenant")))
        order = [c for c in ("tenant_bucket", "tenant", "rule_id") if c in rows.columns]
        rows.sortWithinPartitions(*order).write.partitionBy("tenant_bucket").parquet(folder)
        return folder

    def commit(
        self, appended: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None, base: Version | None = None
    ) -> Version:
        """Rows added to some tables and other tables replaced, in one step. ``base`` is the version the rows were made from, by
        default the newest: if another writer made the next one by now, nothing changes and ``VersionTaken`` is raised. A table
        that grows new columns has them, null in older rows."""
        base = base or self.version()
        folders, schemas = dict(base.folders), dict(base.schemas)
        for table, df in (replaced or {}).items():
            folders[table], schemas[table] = [self._write(table, df)], json.loads(df.schema.json())
        for table, df in (appended or {}).items():
            folders[table] = [*folders.get(table, []), self._write(table, df)]
            schemas[table] = _widened(schemas.get(table), df.schema)
        version = Version(base.number + 1, folders, schemas)
        self._publish(version)
        return version

    def append(self, table: str, df: DataFrame) -> None:
        self.commit(appended={table: df})

    def replace(self, table: str, df: DataFrame) -> None:
        """Replace the whole table by ``df``."""
        self.commit(replaced={table: df})

    def erase(self, table: str, tenant: str) -> None:
        """Delete every row of a tenant from one table."""
        self.erase_tenant(tenant, [table])

    def erase_tenant(self, tenant: str, tables: Iterable[str] | None = None) -> Version:
        """Delete every row of a tenant from the tables (by default all) in one step."""
        base = self.version()
        named = base.folders if tables is None else tables
        return self.commit(replaced={t: without_tenant(self.read(t, at=base), tenant) for t in named}, base=base)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete manifests but the last ``keep`` and the folders that these do not name; the folders that went. Only when no job still
        reads an older version or has folders written that it has not committed."""
        files, path = self._files()
        numbers = self.versions()
        named = {f for n in numbers[-keep:] for fs in self.version(n).folders.values() for f in fs}
        tables = {t for n in numbers for t in self.version(n).folders}
        gone = []
        for table in sorted(tables):
            folder = f"{self.root.rstrip('/')}/{table}"
            for status in files.listStatus(path(folder)):
                own = f"{folder}/{status.getPath().getName()}"
                if own not in named:
                    files.delete(path(own), True)
                    gone.append(own)
        for number in numbers[:-keep]:
            files.delete(path(self._manifest(number)), False)
        return gone


def _widened(known: dict | None, new: StructType) -> dict:
    """The fields of a table and those that new rows bring."""
    if known is None:
        return json.loads(new.json())
    fields = {f.name: f for f in StructType.fromJson(known).fields}
    return json.loads(StructType([*fields.values(), *(f for f in new.fields if f.name not in fields)]).json())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: later uses neither recompute nor lose it when an
    executor goes away."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- saving --------------------------------------------------------------------------------------

def scan_tables(
    result: ScanResult,
    scan_id: int,
    created_at: str,
    read_at: str | None = None,
    full: bool = True,
    catalog_totals: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The rows a result adds to every table, with all its findings."""
    from wareproof.operators.summary import quality_score

    number = F.lit(scan_id).cast("bigint").alias("scan_id")
    all_findings = materialize(result.findings, "findings")
    totals = result.profile.select("tenant", F.col("n_items").alias("total"))
    header = quality_score(all_findings, totals).join(high_counts(all_findings), "tenant", "left")
    if result.ignored is not None:
        header = header.join(result.ignored, "tenant", "left")
    else:
        header = header.withColumn("ignored", F.lit(0))
    if catalog_totals is not None:
        header = header.join(catalog_totals.select("tenant", "catalog_total"), "tenant", "left")
    else:
        header = header.withColumn("catalog_total", F.col("total"))
    header = header.select(
        "tenant", number, "score", "total", "clean", "open",
        F.coalesce("high", F.lit(0)).cast("bigint").alias("high"), F.lit(full).alias("full"),
        F.greatest("total", F.coalesce("catalog_total", "total")).cast("bigint").alias("catalog_total"),
        F.coalesce("ignored", F.lit(0)).cast("bigint").alias("ignored"),
        F.lit(read_at or created_at).cast("timestamp").alias("read_at"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )
    tables = {
        "findings": all_findings, "scan_rules": rule_counts(all_findings), "scan_products": result.covered,
        "scan_context": result.profile.drop("attribute_rules"), "scan_types": result.types,
    }
    if result.names is not None:
        tables["scan_names"] = result.names
    if "attribute_rules" in result.profile.columns:
        tables["scan_attributes"] = result.profile.select("tenant", "attribute_rules")
    return {t: df.withColumn("scan_id", number) for t, df in tables.items()} | {"scans": header}


def save_scan(store: Store, result: ScanResult, scan_id: int, created_at: str, **more) -> Version:
    """Append a result of all its tenants to all tables, in one step."""
    return store.commit(appended=scan_tables(result, scan_id, created_at, **more))


def save_and_prune(
    store: Store, result: ScanResult, scan_id: int, created_at: str, rows: int, full_rows: int, fix_log: DataFrame | None = None, **more
) -> Version:
    """Save a result, take the snapshot of its day and drop what retention does not keep: one step, seen as a whole or not at all.

    A job that ends before the last moment leaves the store as it was, and so does one that another writer was faster than."""
    base = store.version()
    fresh = scan_tables(result, scan_id, created_at, **more)

    def grown(table: str) -> DataFrame:
        new = fresh[table]
        return store.read(table, at=base).unionByName(new, allowMissingColumns=True) if table in base.folders else new

    scans = materialize(grown("scans"), "scans")
    keep = materialize(retained(scans, rows, full_rows), "retained")
    # What is dropped is known from the short table of results; tables without a dropped row only grow.
    dropped = not scans.select("tenant", "scan_id").join(keep, ["tenant", "scan_id"], "left_anti").isEmpty()
    names = [t for t in TABLES if t in fresh or t in base.folders]
    if dropped:
        held = {t: grown(t) if t in fresh else store.read(t, at=base) for t in names}
        replaced = {t: df.join(keep, ["tenant", "scan_id"], "left_semi") for t, df in held.items()}
        appended = {}
    else:
        replaced, appended = {}, fresh
    log = fix_log if fix_log is not None else store.read("fix_log", at=base) if "fix_log" in base.folders else None
    days = first_of_day(fresh["scans"], log)
    if "daily_snapshot" in base.folders:
        days = days.join(store.read("daily_snapshot", at=base).select("tenant", "date"), ["tenant", "date"], "left_anti")
    return store.commit(appended=appended | {"daily_snapshot": days}, replaced=replaced, base=base)


def high_counts(findings: DataFrame) -> DataFrame:
    """(tenant, high): findings of high severity."""
    dim = F.broadcast(checks_table(findings.sparkSession).filter("severity = 'high'").select("rule_id"))
    return findings.join(dim, "rule_id", "left_semi").groupBy("tenant").agg(F.count(F.lit(1)).alias("high"))


def save_snapshots(store: Store, scans: DataFrame, fix_log: DataFrame, existing: DataFrame | None = None) -> None:
    """Daily snapshots of saved results, one per tenant and day; days already there stay as they are."""
    fresh = first_of_day(scans, fix_log)
    if existing is not None:
        fresh = fresh.join(existing.select("tenant", "date"), ["tenant", "date"], "left_anti")
    store.append("daily_snapshot", fresh)


# ---- reading -------------------------------------------------------------------------------------

def latest(scans: DataFrame) -> DataFrame:
    """The newest result of every tenant: a partial aggregation, no sort."""
    facts = [c for c in scans.columns if c != "tenant"]
    newest = scans.groupBy("tenant").agg(
        F.max_by(F.struct(*facts), F.struct("created_at", "scan_id")).alias("_s")
    )
    return newest.select("tenant", "_s.*")


def latest_summary(scans: DataFrame, scan_rules: DataFrame) -> DataFrame:
    """The newest header with open and high counts from the per-check counts of checks that exist."""
    dim = F.broadcast(checks_table(scans.sparkSession).select("rule_id", "severity"))
    counts = scan_rules.join(dim, "rule_id").groupBy("tenant", "scan_id").agg(
        F.sum("count").alias("open"),
        F.sum(F.when(F.col("severity") == "high", F.col("count")).otherwise(0)).alias("high"),
    )
    head = latest(scans.drop("open", "high"))
    return head.join(counts, ["tenant", "scan_id"], "left").withColumns(
        {
            "open": F.coalesce("open", F.lit(0)),
            "high": F.coalesce("high", F.lit(0)),
            "truncated": F.col("catalog_total") > F.col("total"),
        }
    )


def by_id(scans: DataFrame, tenant: str, scan_id: int) -> DataFrame:
    return scans.filter((F.col("tenant") == tenant) & (F.col("scan_id") == scan_id))


def saved_since(scans: DataFrame, reference: DataFrame) -> DataFrame:
    """(tenant, saved): results saved after the given (tenant, scan_id)."""
    ref = reference.select("tenant", F.col("scan_id").alias("_ref"))
    newer = scans.select("tenant", "scan_id").join(ref, "tenant").filter(F.col("scan_id") > F.col("_ref"))
    counts = newer.groupBy("tenant").agg(F.count(F.lit(1)).alias("saved"))
    return ref.join(counts, "tenant", "left").select("tenant", F.coalesce("saved", F.lit(0)).alias("saved"))


def history(scans: DataFrame, scan_rules: DataFrame, n: int) -> DataFrame:
    """The last ``n`` full scans, oldest first, each with its open count."""
    counts = scan_rules.groupBy("tenant", "scan_id").agg(F.sum("count").alias("open"))
    w = Window.partitionBy("tenant").orderBy(F.col("created_at").desc(), F.col("scan_id").desc())
    recent = (
        scans.filter("full").select("tenant", "scan_id", "total", "created_at")
        .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    )
    return recent.join(counts, ["tenant", "scan_id"], "left").select(
        "tenant", "scan_id", F.col("created_at").alias("at"), "total", F.coalesce("open", F.lit(0)).alias("open")
    ).orderBy("tenant", "at")


def retained(scans: DataFrame, rows: int, full_rows: int) -> DataFrame:
    """(tenant, scan_id) that stay: the last ``rows`` results and the last ``full_rows`` full ones."""
    w = Window.partitionBy("tenant").orderBy(F.col("scan_id").desc())
    last = scans.select("tenant", "scan_id").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows)
    last_full = (
        scans.filter("full").select("tenant", "scan_id")
        .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= full_rows)
    )
    return last.unionByName(last_full).select("tenant", "scan_id").distinct()


TABLES = ("findings", "scan_rules", "scan_products", "scan_context", "scan_types", "scan_names", "scan_attributes", "scans")


def prune(store: Store, rows: int, full_rows: int, tables: tuple[str, ...] = TABLES) -> Version:
    """Drop what retention does not keep from every table that is there, in one step."""
    base = store.version()
    keep = materialize(retained(store.read("scans", at=base), rows, full_rows), "retained")
    there = [t for t in tables if t in base.folders]
    return store.commit(replaced={t: store.read(t, at=base).join(keep, ["tenant", "scan_id"], "left_semi") for t in there}, base=base)


def retried(step: Callable[[], Version], times: int = 5) -> Version:
    """A step that starts from the newest version, taken again if another writer came in between."""
    for _ in range(times - 1):
        try:
            return step()
        except VersionTaken:
            continue
    return step()


def without_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """A table without the rows of one tenant."""
    return df.filter(F.col("tenant") != tenant)


def store_stats(scans: DataFrame, fix_log: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: tenants, results, fixes in place and undone."""
    tenants = sessions.agg(F.countDistinct("tenant").alias("tenants"))
    results = scans.agg(F.count(F.lit(1)).alias("scans"))
    fixes = fix_log.agg(
        F.count_if(~F.col("undone")).alias("fixes_in_place"), F.count_if(F.col("undone")).alias("fixes_undone")
    )
    one = F.lit(1)
    return (
        tenants.withColumn("_k", one).join(results.withColumn("_k", one), "_k")
        .join(fixes.withColumn("_k", one), "_k").drop("_k")
    )


def parse_saved_json(rows: DataFrame, findings_ddl: str, rules_ddl: str) -> DataFrame:
    """Results whose findings and rules are JSON text. A damaged column falls back to an empty list
    and never fails the read; damaged findings mark the row ``corrupt``."""
    parsed = rows.withColumns(
        {
            "_findings": F.from_json("findings", f"array<struct<{findings_ddl}>>"),
            "_rules": F.from_json("rules", f"array<struct<{rules_ddl}>>"),
        }
    )
    return parsed.withColumns(
        {
            "corrupt": F.col("_findings").isNull(),
            "findings": F.coalesce("_findings", F.array().cast(f"array<struct<{findings_ddl}>>")),
            "rules": F.coalesce("_rules", F.array().cast(f"array<struct<{rules_ddl}>>")),
        }
    ).drop("_findings", "_rules")
