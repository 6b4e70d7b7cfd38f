"""The queue of items that need a person."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ["id", "subsystem", "priority", "reason", "source_id", "field", "confidence", "value"]
SUBSYSTEMS = ["CLASSIFICATION", "DETECTION", "ASSET_QUALITY", "OCR_GUN", "UID"]


def _items(df: DataFrame, subsystem: str, item_id: Column, priority, reason, source, field: str, confidence, value) -> DataFrame:
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        item_id.alias("id"), F.lit(subsystem).alias("subsystem"), c(priority).cast("string").alias("priority"), c(reason).alias("reason"),
        c(source).cast("string").alias("source_id"), F.lit(field).alias("field"), c(confidence).cast("double").alias("confidence"), c(value).cast("string").alias("value"),
    )


def classification_items(df: DataFrame) -> DataFrame:
    """df: source_id, decision, category, confidence, alternatives (count)."""
    d = F.col("decision")
    todo = df.where(d.isin("REVIEW", "UNKNOWN", "ERROR"))
    reason = F.when(d == "ERROR", "CLASSIFICATION_ERROR").when(d == "UNKNOWN", "CLASSIFICATION_UNKNOWN").when(F.col("alternatives") > 0, "CLASSIFICATION_AMBIGUOUS").otherwise("CLASSIFICATION_LOW_CONFIDENCE")
    priority = F.when(d == "ERROR", "P0").when(d == "UNKNOWN", "P1").otherwise("P2")
    return _items(todo, "CLASSIFICATION", F.concat_ws(":", F.lit("review"), "source_id", F.lit("classification")), priority, reason, F.col("source_id"), "category", F.col("confidence"), F.col("category"))


def detection_items(df: DataFrame) -> DataFrame:
    """df: source_id, status (OK, ERROR, DEFERRED, NO_GRID), category, confidence, fallback, weak."""
    s = F.col("status")
    todo = df.where((s != "OK") | F.col("fallback") | F.col("weak"))
    priority = F.when(s == "ERROR", "P0").when((s == "NO_GRID") & F.col("category").isin("GUN", "VEHICLE"), "P1").otherwise("P2")
    reason = (
        F.when(s == "ERROR", "PIPELINE_ERROR").when(s == "DEFERRED", "DEFERRED_DETECTION").when(s == "NO_GRID", "NO_GRID")
        .when(F.col("fallback"), "SEMANTIC_FALLBACK").otherwise("SPECIALIZED_DETECTOR_LOW_CONFIDENCE")
    )
    return _items(todo, "DETECTION", F.concat_ws(":", F.lit("review"), "source_id", F.lit("detection")), priority, reason, F.col("source_id"), "detection", F.col("confidence"), s)


def quality_items(df: DataFrame) -> DataFrame:
    """df: asset_id, source_id, partial, empty, locked, unsure, confidence, manual."""
    reason = F.when(F.col("partial"), "PARTIAL_ASSET").when(F.col("empty"), "EMPTY_SUSPECTED").when(F.col("locked"), "LOCKED_ASSET").when(F.col("unsure"), "QUALITY_REVIEW")
    todo = df.where(~F.col("manual")).withColumn("__r", reason).where("__r is not null")
    return _items(todo, "ASSET_QUALITY", F.concat_ws(":", F.lit("review"), "asset_id", F.lit("quality"), "__r"), "P3", F.col("__r"), F.col("source_id"), "quality", F.col("confidence"), F.col("__r"))


def field_items(df: DataFrame, field: str, reason: str, accept: float = 0.8) -> DataFrame:
    """df: asset_id, source_id, value, confidence: values that are missing or below ``accept``."""
    todo = df.where(F.col("value").isNull() | (F.col("confidence") < accept))
    return _items(todo, "OCR_GUN", F.concat_ws(":", F.lit("review"), "asset_id", F.lit("ocr"), F.lit(field)), "P2", reason, F.col("source_id"), field, F.col("confidence"), F.col("value"))


def id_items(df: DataFrame) -> DataFrame:
    """df: account, has_conflict, review_required, confidence, best."""
    todo = df.where("review_required")
    conflict = F.col("has_conflict")
    return _items(todo, "UID", F.concat_ws(":", F.lit("review"), F.col("account").cast("string"), F.lit("uid")), F.when(conflict, "P1").otherwise("P2"), F.when(conflict, "UID_CONFLICT").otherwise("UID_LOW_CONFIDENCE"), F.lit(None), "uid", F.col("confidence"), F.col("best"))


def queue(parts: list[DataFrame]) -> DataFrame:
    """The sub-queues as one; of items with one id that of the later sub-queue stays."""
    tagged = reduce(DataFrame.unionByName, [p.select(*ITEM).withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy("id").orderBy(F.col("__part").desc())
    return tagged.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__part", "__n")


#: Of how many items the bounds of blocks are taken, and how many blocks there are at most.
SAMPLE, BLOCKS = 1024, 64


def _numbered(rows: DataFrame, scope: Column, order: list[Column], by: Column, number: str) -> DataFrame:
    """``rows`` with their places from 0 in ``order`` within ``scope``, without bringing a scope into one task.

    The bounds of a bounded sample, those rows whose ``by`` has the least hash, part all rows into blocks that follow each other in order.
    A place is the rows of earlier blocks of the scope and the place in its own block; it doesn't depend on the sample.
    """
    keyed = rows.withColumn("__key", F.struct(scope.alias("s"), *[c.alias(f"k{i}") for i, c in enumerate(order)]))
    kinds = [f.dataType.simpleString() for f in keyed.schema["__key"].dataType.fields]
    sample = keyed.select("__key", F.xxhash64(by).alias("__h")).orderBy("__h", "__key").limit(SAMPLE).select("__key").orderBy("__key").collect()
    bounds = sample[:: max(1, -(-len(sample) // (BLOCKS - 1)))]
    block = F.lit(0)
    if bounds:
        # one expression of text, since thousands of calls for single literals take seconds
        text = lambda v: "NULL" if v is None else f"decode(unhex('{str(v).encode().hex()}'), 'UTF-8')"
        fixed = F.expr(f"array({', '.join('named_struct(' + ', '.join(f'{n!r}, CAST({text(v)} AS {k})' for n, v, k in zip(r[0].asDict(), r[0], kinds)) + ')' for r in bounds)})")
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
        block = F.aggregate(steps, F.lit(0), lambda at, jump: F.when((at + jump <= len(bounds)) & (F.get(fixed, at + jump - 1) <= F.col("__key")), at + jump).otherwise(at))
    keyed = keyed.withColumn("__block", block)
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(F.col("__key.s").alias("__s"), F.col("__block").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select("__s", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = keyed.withColumn("__place", F.row_number().over(Window.partitionBy("__key.s", "__block").orderBy("__key")))
    placed = placed.join(counts, F.col("__key.s").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    return placed.withColumn(number, (F.col("__before") + F.col("__place") - 1).cast("int")).drop("__key", "__block", "__place", "__s", "__b", "__before")


def ordered(items: DataFrame, index: DataFrame, scope: str | None = None) -> DataFrame:
    """Adds order_index from 0 by priority, subsystem, source index (9999 if unknown), field, id; within ``scope`` if given.

    index: source_id, source_index. Queues may be of any size: they are numbered block by block.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SUBSYSTEMS]), F.col("subsystem"))
    rows = items.join(index.select(F.col("source_id").cast("string").alias("source_id"), "source_index"), "source_id", "left")
    order = [F.col("priority"), rank, F.coalesce("source_index", F.lit(9999)), F.coalesce("field", F.lit("")), F.col("id")]
    return _numbered(rows, F.col(scope) if scope else F.lit(0), order, F.col("id"), "order_index").drop("source_index")


def reconciled(new: DataFrame, old: DataFrame) -> DataFrame:
    """Status of generated items given earlier ones (id, status, action, fingerprint).

    Manual overrides stay; an accepted machine value stays accepted while its fingerprint does,
    else it is open again; rejected and skipped stay; items no longer generated are gone.
    """
    o = old.select("id", F.col("status").alias("__s"), F.col("action").alias("__a"), F.col("fingerprint").alias("__f"))
    manual = F.col("__s") == "RESOLVED_MANUAL"
    same = F.col("__f") == F.col("fingerprint")
    status = (
        F.when(manual & (F.col("__a") != "accept_machine"), "RESOLVED_MANUAL")
        .when(manual & (F.col("__a") == "accept_machine") & same, "RESOLVED_MANUAL")
        .when(F.col("__s").isin("REJECTED", "SKIPPED"), F.col("__s")).otherwise("OPEN")
    )
    stale = manual & (F.col("__a") == "accept_machine") & ~same
    return new.join(o, "id", "left").withColumn("status", status).withColumn("stale", F.coalesce(stale, F.lit(False))).drop("__s", "__a", "__f")


def summary(items: DataFrame) -> DataFrame:
    """Counts by status and of open items by priority, one row."""
    s = F.col("status")
    counts = [F.count_if(s == x).alias(x.lower()) for x in ("OPEN", "RESOLVED_MANUAL", "REJECTED", "SKIPPED")]
    return items.agg(*counts, *[F.count_if((s == "OPEN") & (F.col("priority") == p)).alias(f"open_{p.lower()}") for p in ("P0", "P1", "P2", "P3")])


def listed(items: DataFrame, status: str | None = None, subsystem: str | None = None, priority: str | None = None) -> DataFrame:
    """Items by any of status, subsystem and priority."""
    for c, v in (("status", status), ("subsystem", subsystem), ("priority", priority)):
        if v is not None:
            items = items.where(F.col(c) == v)
    return items


def recategorised(changes: DataFrame, **derived: DataFrame) -> dict[str, DataFrame]:
    """What is left of derived tables (each with source_id) once the sources in ``changes`` got another category by hand."""
    gone = changes.select("source_id").distinct()
    return {k: df.join(gone, "source_id", "left_anti") for k, df in derived.items()}


def recorded(log: DataFrame, target: str, field: str, value: str, at: str) -> DataFrame:
    """The log with one more manual change."""
    row = log.sparkSession.createDataFrame([(target, field, value, at)], "target string, field string, value string, at string")
    return log.unionByName(row.select(*[F.col(c).cast(t) for c, t in log.dtypes]))
