"""Item tables in buckets, sums that move, and versions of the store."""

import json

import pytest
from pyspark.sql import functions as F

from catalog_rows import ROWS
from test_suite import AS_OF_LIT
from wareproof.operators import incremental, rolling
from wareproof.operators.item_checks import Limits
from wareproof.operators.summary import quality_score, rule_counts
from wareproof.plans.scan import Context, catalog_findings, row_findings, scan
from wareproof.schema import RECORD
from wareproof.sources import store
from wareproof.sources.buckets import ItemTables, item_bucket
from wareproof.sources.reads import by_ids
from wareproof.sources.records import from_records

RULES = ["missing_vendor", "no_tags", "missing_sku", "title_all_caps", "vendor_casing", "duplicate_title", "few_images"]


@pytest.fixture(scope="module")
def catalog(spark):
    return from_records(spark.createDataFrame(ROWS, RECORD))


@pytest.fixture(scope="module")
def ctx(spark):
    return Context(limits=Limits(as_of=F.expr(AS_OF_LIT)))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def folders(df):
    return {f.split("item_bucket=")[1].split("/")[0] for f in df.inputFiles()}


def test_given_items_are_read_from_their_buckets_alone(spark, catalog, tmp_path):
    tables = ItemTables(spark, str(tmp_path / "t"), 32).store(catalog)
    some = [(r.tenant, r.id) for r in catalog.items.orderBy("id").limit(2).collect()]
    asked = spark.createDataFrame([*some, ("t1", "nowhere")], "tenant string, product_id string")
    numbers = tables.numbers(asked)
    part = by_ids(tables, asked)
    whole = by_ids(catalog, asked)
    for name in ("items", "variants", "memberships"):
        got, want = getattr(part, name), getattr(whole, name)
        assert rows_of(got.select(*want.columns)) == rows_of(want)
    plan = part.items._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "item_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(numbers) <= 3 < len(folders(tables.read("items")))
    assert tables.catalog([]).items.count() == 0
    n = catalog.items.select(item_bucket("tenant", "id", 32).alias("n")).distinct().count()
    assert len(folders(tables.read("items"))) == n


def test_sums_move_like_a_full_rebuild(spark, catalog, ctx, tmp_path):
    """Twice in a row: items that change, come and go."""
    tables = ItemTables(spark, str(tmp_path / "t"), 8).store(catalog)
    full = row_findings(catalog, ctx, RULES).unionByName(catalog_findings(catalog, ctx, RULES))
    old = store.materialize(full.filter("pos % 3 <> 0").unionByName(full.filter("pos % 5 = 0").withColumn("product_id", F.concat(F.lit("gone-"), "product_id"))), "old")
    ids = catalog.items.select("tenant", F.col("id").alias("product_id"), "pos")
    covered = store.materialize(ids.filter("pos % 4 <> 1").select("tenant", "product_id").unionByName(
        old.filter("product_id LIKE 'gone-%'").select("tenant", "product_id").distinct()), "covered")
    tables.write("findings", old)
    totals = covered.groupBy("tenant").agg(F.count(F.lit(1)).alias("total"))
    state = rolling.state_of(old, totals)
    assert rows_of(rolling.summary_of(state)) == rows_of(quality_score(old, totals))
    for k in (0, 1):
        asked = ids.filter(F.col("pos") % 2 == k).select("tenant", "product_id")
        asked = store.materialize(asked.unionByName(asked.select("tenant", F.concat(F.lit("gone-"), "product_id").alias("product_id"))), "asked")
        every = store.materialize(tables.read("findings"), "every")
        tables.write("item_sums", state.items)
        before = state
        out, after = incremental.refreshed(tables, asked, covered, ctx, state, RULES, folder=str(tmp_path / f"f{k}"))
        # The same over all findings at once.
        whole = incremental.recheck(catalog, asked, every, covered, ctx, RULES)
        now = whole.covered.groupBy("tenant").agg(F.count(F.lit(1)).alias("total"))
        assert rows_of(rolling.summary_of(after)) == rows_of(quality_score(whole.findings, now))
        assert rows_of(after.rules.select("tenant", "rule_id", "count")) == rows_of(rule_counts(whole.findings).select("tenant", "rule_id", "count"))
        change = {r.rule_id: (r.before, r.after) for r in rolling.rule_changes(before, after, "no_tags").collect()}
        count = lambda df: df.filter("rule_id = 'no_tags'").count()
        assert change.get("no_tags", (0, 0)) == (count(every), count(whole.findings))
        merged = store.materialize(whole.findings, "merged")
        tables.write("findings", merged)
        covered = store.materialize(whole.covered, "covered")
        state = rolling.state_of(merged, now) if k else rolling.State(rolling.state_of(merged, now).items, *(store.materialize(d, "s") for d in (after.rules, after.tenants)))


def test_nothing_moves_without_changes(spark, catalog, ctx, tmp_path):
    full = store.materialize(row_findings(catalog, ctx, RULES), "full")
    assert rolling.signed(full, full).count() == 0
    state = rolling.state_of(full.limit(0), spark.createDataFrame([("t1", 3), ("t2", 0)], "tenant string, total bigint"))
    none = rolling.signed(full.limit(0), full.limit(0))
    assert rows_of(rolling.summary_of(rolling.moved(state, none))) == [("t1", 3, 100, 3, 0), ("t2", 0, 100, 0, 0)]


# ---- versions of the store -----------------------------------------------------------------------

WORDS = "tenant string, word string"


def words(spark, *rows):
    return spark.createDataFrame(list(rows), WORDS)


def test_a_reader_keeps_its_version(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.version().number == 0 and not s.exists("a")
    with pytest.raises(KeyError):
        s.read("a")
    s.commit(appended={"a": words(spark, ("t1", "x")), "b": words(spark, ("t1", "y"))})
    seen = s.version()
    before = s.read("a", at=seen)
    s.replace("a", words(spark, ("t2", "z")))
    s.append("b", words(spark, ("t2", "w")))
    assert rows_of(before) == [("t1", "x")] == rows_of(s.read("a", at=seen))
    assert rows_of(s.read("a")) == [("t2", "z")] and rows_of(s.read("b")) == [("t1", "y"), ("t2", "w")]
    assert s.version(1) == seen and s.versions() == [1, 2, 3]


def test_a_job_that_ends_between_two_steps_changes_nothing(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "s"))
    s.commit(appended={"a": words(spark, ("t1", "x")), "b": words(spark, ("t1", "y"))})
    written = []
    whole = store.Store._write

    def ends(self, table, df):
        if written:
            raise OSError("lost")
        written.append(table)
        return whole(self, table, df)

    monkeypatch.setattr(store.Store, "_write", ends)
    with pytest.raises(OSError):
        s.commit(replaced={"a": words(spark, ("t9", "q")), "b": words(spark, ("t9", "q"))})
    monkeypatch.setattr(store.Store, "_write", whole)
    assert written == ["a"] and s.version().number == 1
    assert rows_of(s.read("a")) == [("t1", "x")] and rows_of(s.read("b")) == [("t1", "y")]
    gone = s.vacuum()
    assert len(gone) == 1 and rows_of(s.read("a")) == [("t1", "x")]


def test_of_two_writers_one_is_told(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.append("a", words(spark, ("t1", "x")))
    base = s.version()
    s.commit(appended={"a": words(spark, ("t1", "first"))}, base=base)
    with pytest.raises(store.VersionTaken):
        s.commit(replaced={"a": words(spark, ("t1", "second"))}, base=base)
    assert rows_of(s.read("a")) == [("t1", "first"), ("t1", "x")]
    bases = iter([base, s.version()])
    done = store.retried(lambda: s.commit(appended={"a": words(spark, ("t1", "third"))}, base=next(bases)))
    assert done.number == 3 and s.read("a").count() == 3


def test_columns_that_come_later(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.append("a", words(spark, ("t1", "x")))
    s.append("a", words(spark, ("t1", "y")).withColumn("n", F.lit(1)))
    assert rows_of(s.read("a")) == [("t1", "x", None), ("t1", "y", 1)]
    assert rows_of(s.read("a", "t2")) == []


def test_one_step_saves_snapshots_and_prunes(spark, catalog, ctx, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "s"))
    result = scan(catalog, ctx, ["no_tags", "missing_sku"])
    for n in range(1, 5):
        store.save_and_prune(s, result, n, f"2024-05-0{n} 10:00:00", rows=2, full_rows=1)
        assert s.version().number == n
    assert sorted({r.scan_id for r in s.read("scans").collect()}) == [3, 4]
    assert sorted({r.scan_id for r in s.read("findings").collect()}) == [3, 4]
    assert sorted({str(r.date) for r in s.read("daily_snapshot").collect()}) == [f"2024-05-0{n}" for n in range(1, 5)]
    # A job that ends before its manifest leaves the version before.
    held = rows_of(s.read("scans").select("tenant", "scan_id"))
    monkeypatch.setattr(store.Store, "_publish", lambda self, version: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.save_and_prune(s, result, 5, "2024-05-05 10:00:00", rows=2, full_rows=1)
    assert rows_of(s.read("scans").select("tenant", "scan_id")) == held and s.version().number == 4
    monkeypatch.undo()
    s.erase_tenant("t1")
    assert all(s.read(t).filter("tenant = 't1'").count() == 0 for t in s.version().folders)
    # Old versions stay until they are cleared away.
    assert s.read("scans", at=s.version(4)).count() > 0
    s.vacuum()
    assert s.versions() == [5]


def test_manifests_are_plain_text(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.append("a", words(spark, ("t1", "x")))
    said = json.loads((tmp_path / "s" / store.MANIFESTS / "000000000001.json").read_text())
    assert list(said["folders"]) == ["a"] and said["schemas"]["a"]["fields"][0]["name"] == "tenant"
