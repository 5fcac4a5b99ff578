"""Change events: a stream of item ids that keeps stored findings current, or fills a queue.

Every micro-batch writes under its own batch number and overwrites that on replay, so a batch that
runs twice leaves the same files. Only the touched items are written; ``current_findings`` lays them
over the stored base when it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wareproof.operators.incremental import KEY, added_deleted, splice
from wareproof.operators.registry import RULE_IDS
from wareproof.operators.skew import ranked
from wareproof.operators.summary import apply_ignores
from wareproof.plans.scan import Context, row_findings, stored
from wareproof.schema import FINDING
from wareproof.sources.reads import by_ids
from wareproof.sources.buckets import ItemTables
from wareproof.sources.records import Catalog

C = F.col
CHANGE = "tenant string, product_id string, created boolean, at timestamp"


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def recheck_stream(
    events: DataFrame,
    load_catalog: Callable[[SparkSession], Catalog | ItemTables],
    context: Callable[[SparkSession], Context],
    covered: Callable[[SparkSession], DataFrame],
    out: str,
    checkpoint: str,
    rules: Sequence[str] = RULE_IDS,
    ignores: Callable[[SparkSession], DataFrame] | None = None,
    queue_for: Callable[[SparkSession], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Recheck the changed items of every micro-batch.

    The catalog is read anew per batch, of tables in buckets only those of the changed items, so an event only says which item to look at: it may
    repeat or come late, and nothing is remembered between batches. Tenants listed by ``queue_for`` are queued under ``out/pending``
    instead, and so is a whole batch whose evaluation fails.
    """

    def evaluated(batch: DataFrame, ids: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        catalog = load_catalog(spark)
        part = stored(by_ids(catalog, ids), f"{out}/features/batch={batch_id}")
        fresh = row_findings(part, context(spark), rules)
        if ignores is not None:
            fresh = apply_ignores(fresh, ignores(spark))
        present = part.items.select("tenant", C("id").alias("product_id"))
        changes = added_deleted(ids, covered(spark), present)
        _write(fresh, f"{out}/fresh", batch_id)
        # The touched list goes last: a reader sees a batch only when its findings are complete.
        _write(ids.select(*KEY).join(changes, KEY, "left"), f"{out}/touched", batch_id)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # Many joins below ask for these ids: events are read and grouped once, and Spark knows how few the written ids are.
        ids = queue_items(batch)
        ids.write.mode("overwrite").parquet(f"{out}/ids/batch={batch_id}")
        ids = batch.sparkSession.read.schema(ids.schema).parquet(f"{out}/ids/batch={batch_id}")
        later = None
        if queue_for is not None:
            listed = queue_for(batch.sparkSession).select("tenant").distinct()
            later = ids.join(listed, "tenant", "left_semi")
        try:
            evaluated(batch, ids if later is None else ids.join(listed, "tenant", "left_anti"), batch_id)
        except PySparkException:
            later = ids
        if later is not None:
            _write(later, f"{out}/pending", batch_id)

    return (
        events.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table of batches; empty while none was written."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ddl)


def current_findings(spark: SparkSession, base: DataFrame, out: str) -> DataFrame:
    """The stored findings with every rechecked item replaced by its latest batch."""
    touched = _read(spark, f"{out}/touched", "tenant string, product_id string, change string, batch bigint")
    last = touched.groupBy(*KEY).agg(
        F.max("batch").alias("batch"), F.max_by("change", "batch").alias("change")
    )
    fresh = _read(spark, f"{out}/fresh", f"{FINDING}, batch bigint")
    fresh = fresh.join(last.select(*KEY, "batch"), [*KEY, "batch"], "left_semi").drop("batch")
    return splice(base, last, fresh, last.filter("change = 'deleted'"))


def compact(spark: SparkSession, base: DataFrame, out: str, to: str) -> DataFrame:
    """Write the current findings to ``to``, the new base: with it, the batches up to now need not be read again.
    Returns the new base."""
    current_findings(spark, base, out).write.parquet(to)
    return spark.read.parquet(to)


# ---- the queue -----------------------------------------------------------------------------------

def pending_stream(events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Queue changed items: each once per batch, with whether it was created."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        _write(queue_items(batch), out, batch_id)

    return (
        events.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def queue_items(events: DataFrame) -> DataFrame:
    """(tenant, product_id, created, at): each item once; created once means created."""
    return events.groupBy(*KEY).agg(
        F.bool_or(F.coalesce("created", F.lit(False))).alias("created"), F.min("at").alias("at")
    )


TAKEN = "tenant string, product_id string, through bigint"


def pending(spark: SparkSession, path: str) -> DataFrame:
    """The queue over all batches written so far, without what was taken off it. Also (batch) the last batch
    an item was queued in."""
    queued = _read(spark, path, f"{CHANGE}, batch bigint")
    taken = _read(spark, f"{path}-taken", TAKEN).groupBy(*KEY).agg(F.max("through").alias("_through"))
    left = queued.join(taken, KEY, "left").filter(C("_through").isNull() | (C("batch") > C("_through")))
    return left.groupBy(*KEY).agg(
        F.bool_or(F.coalesce("created", F.lit(False))).alias("created"), F.min("at").alias("at"), F.max("batch").alias("batch")
    )


def take_off(scanned: DataFrame, path: str, drain_id: int) -> None:
    """Take items (tenant, product_id, batch) of ``pending`` off the queue, up to the batch they were seen in: what
    is queued later stays. Writes under its own number and may run twice."""
    rows = scanned.select(*KEY, C("batch").alias("through"))
    rows.write.mode("overwrite").parquet(f"{path}-taken/drain={drain_id}")


def pending_count(queue: DataFrame) -> DataFrame:
    return queue.groupBy("tenant").agg(F.count(F.lit(1)).alias("pending"))


def drain(queue: DataFrame, covered: DataFrame, room: DataFrame | None = None) -> DataFrame:
    """The queued items with ``action`` scan or hold.

    Items the stored result covers are always scanned; new ones, oldest first, while ``room`` (tenant, room) lasts.
    """
    known = covered.select(*KEY).distinct().withColumn("known", F.lit(True))
    flagged = queue.join(known, KEY, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    if room is None:
        return flagged.withColumn("action", F.lit("scan"))
    # New items are numbered by the second they were queued in, slice by slice: no task holds a whole tenant.
    new = flagged.filter(~C("known")).withColumn("_second", F.unix_timestamp("at"))
    new = ranked(new, ["tenant"], ["_second", "at", "product_id"], "_nth", slice_width=86_400)
    new = new.join(room.select("tenant", "room"), "tenant", "left")
    fits = C("room").isNull() | (C("_nth") <= F.greatest(F.lit(0), C("room")))
    new = new.withColumn("action", F.when(fits, F.lit("scan")).otherwise("hold")).drop("_second", "_nth", "room")
    return flagged.filter("known").withColumn("action", F.lit("scan")).unionByName(new)


def drained(drain_plan: DataFrame) -> DataFrame:
    """(tenant, scanned, held)."""
    return drain_plan.groupBy("tenant").agg(
        F.count_if(C("action") == "scan").alias("scanned"), F.count_if(C("action") == "hold").alias("held")
    )


def still_queued(queue: DataFrame, drain_plan: DataFrame) -> DataFrame:
    """The queue without the items that were scanned."""
    return queue.join(drain_plan.filter("action = 'scan'").select(*KEY), KEY, "left_anti")
