"""What people decided comes before what the machine found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.geometry import cells, iou


def effective(manual: Column, machine: Column, absent: Column | None = None) -> Column:
    """The manual value, else the machine's; null where a person said there is none."""
    out = F.coalesce(manual, machine)
    return out if absent is None else F.when(F.coalesce(absent, F.lit(False)), None).otherwise(out)


def guarded_choice(items: DataFrame, choices: DataFrame, valid: list[str], default: str) -> DataFrame:
    """Adds choice to items (name, sha256): the saved one if name and sha256 agree and it is valid, else the default."""
    saved = choices.select("name", F.col("sha256").alias("__sha"), F.col("choice").alias("__choice"))
    ok = (F.col("__sha") == F.col("sha256")) & F.col("__choice").isin(*valid)
    return items.join(saved, "name", "left").withColumn("choice", F.when(ok, F.col("__choice")).otherwise(F.lit(default))).drop("__sha", "__choice")


def carried_over(new: DataFrame, old: DataFrame, least: float = 0.7, cell: int = 256) -> DataFrame:
    """old_id for each row of new (source, id, category, rect): same id, else the best overlap of at least ``least`` in the
    category, else the only old row where a source has one old and one new row and their categories agree.

    An old row may be taken more than once. Of equal overlaps the smallest old id wins. Ids are unique within a source; rows
    without a source match nothing. Rows are dealt by source once and meet within it by grid cells, not all with all: a
    source is one screen, so what it holds is bounded.
    """
    rows = new.select("source", "id", "category", "rect", F.lit(True).alias("new"))
    rows = rows.unionByName(old.select("source", "id", "category", "rect", F.lit(False).alias("new"))).repartition("source")
    screen, own = Window.partitionBy("source"), Window.partitionBy("source", "id")
    known = ~F.col("new") & F.col("source").isNotNull()
    lone = (F.count_if(F.col("new")).over(screen) == 1) & (F.count_if(~F.col("new")).over(screen) == 1)
    rows = rows.withColumns({
        "same": F.max(F.when(known, F.col("id"))).over(own),
        "only": F.when(lone, F.max(F.when(known, F.struct("id", "category"))).over(screen)),
    })
    met = rows.withColumn("cell", F.explode_outer(cells(F.col("rect"), cell))).groupBy("source", "category", "cell").agg(
        F.collect_list(F.when(F.col("new"), F.struct("id", "rect", "same", "only"))).alias("news"), F.collect_list(F.when(known, F.struct("id", "rect"))).alias("olds")
    )
    met = met.withColumn("n", F.explode("news"))
    over = F.filter(F.transform("olds", lambda o: F.struct(iou(F.col("n.rect"), o["rect"]).alias("iou"), o["id"].alias("id"))), lambda o: o["iou"] >= least)
    best = met.select("source", "category", "n", F.explode_outer(over).alias("o")).groupBy("source", F.col("n.id").alias("id")).agg(
        F.first("n.same").alias("same"), F.first("n.only").alias("only"), F.first("category").alias("category"),
        F.min_by("o.id", F.when(F.col("o").isNotNull(), F.struct(-F.col("o.iou"), F.col("o.id")))).alias("over"),
    )
    return best.select("source", "id", F.coalesce("same", "over", F.when(F.col("only.category") == F.col("category"), F.col("only.id"))).alias("old_id"))


def with_facts(rows: DataFrame, *facts: tuple[DataFrame, str]) -> DataFrame:
    """``rows`` with what is known of them: each of ``facts`` (one row per key, and the key) joined, null where nothing is."""
    for table, key in facts:
        rows = rows.join(table, key, "left")
    return rows


def latest(actions: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The last value per key of an append-only log of actions."""
    return actions.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def merged_sources(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Upsert: state is new, changed, same or kept, and stale says that what was derived must go."""
    o = old.select(key, F.col(content).alias("__old"))
    out = new.select(key, content).join(o, key, "full")
    state = F.when(F.col("__old").isNull(), "new").when(F.col(content).isNull(), "kept").when(F.col(content) == F.col("__old"), "same").otherwise("changed")
    return out.select(key, F.coalesce(content, "__old").alias(content), state.alias("state"), (state == "changed").alias("stale"))


def to_compute(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose (content, version, route) has no result yet."""
    return tasks.join(done.select(*keys), keys, "left_anti")


def without_stale_assets(assets: DataFrame, sources: DataFrame, detectors: list[str]) -> DataFrame:
    """Assets without those that these detectors made for the given sources, but for manual ones."""
    gone = sources.select("source_id").distinct().withColumn("__s", F.lit(True))
    rows = assets.join(gone, "source_id", "left")
    stale = F.col("__s") & F.col("detector").isin(*detectors) & ~F.col("manual_override")
    return rows.where(~F.coalesce(stale, F.lit(False))).drop("__s")


def without_readings(assets: DataFrame, keep_absent: bool = True) -> DataFrame:
    """Assets with their machine readings cleared and manual ones kept.

    ``keep_absent`` says whether "there is no counter" counts as manual; False is how older state was reset.
    """
    out = assets
    for c in ("level", "weapon_name", "kill_counter"):
        out = out.withColumn(c, F.lit(None).cast(dict(assets.dtypes)[c]))
    return out if keep_absent else out.withColumn("counter_absent_manual", F.lit(False))


def refreshed(assets: DataFrame, readings: DataFrame) -> DataFrame:
    """Machine readings (id, level, weapon_name, kill_counter) put over the old ones, manual columns as they were."""
    fresh = readings.select("id", *[F.col(c).alias("__" + c) for c in ("level", "weapon_name", "kill_counter")])
    rows = assets.join(fresh, "id", "left")
    for c in ("level", "weapon_name", "kill_counter"):
        rows = rows.withColumn(c, F.coalesce("__" + c, c))
    return rows.drop("__level", "__weapon_name", "__kill_counter")


def orphans_pruned(records: DataFrame, *owners: DataFrame) -> DataFrame:
    """Records (owner) whose owner still exists; owners: id."""
    ids = owners[0].select("id")
    for o in owners[1:]:
        ids = ids.union(o.select("id"))
    return records.join(ids.distinct().withColumnRenamed("id", "owner"), "owner", "left_semi")


def stale_items(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Marks open items whose asset is gone."""
    there = assets.select(F.col("id").alias("asset_id"), F.lit(True).alias("__there")).distinct()
    rows = items.join(there, "asset_id", "left")
    return rows.withColumn("status", F.when((F.col("status") == "OPEN") & F.col("__there").isNull(), "STALE").otherwise(F.col("status"))).drop("__there")


ACTIONS = ["accept_machine", "set_category", "set_level", "set_name", "set_counter", "clear_counter", "set_uid", "reject", "restore", "skip"]


def checked_actions(actions: DataFrame) -> DataFrame:
    """Adds error to actions (target, action, value): unknown actions and values out of bounds."""
    a, v = F.col("action"), F.col("value")
    level = v.try_cast("int")
    error = (
        F.when(~a.isin(*ACTIONS), "unknown action")
        .when((a == "set_level") & ~F.coalesce(level.between(1, 20), F.lit(False)), "level must be 1 to 20")
        .when((a == "set_counter") & ~F.coalesce(v.rlike("^[0-9]{1,8}$"), F.lit(False)), "counter must be 1 to 8 digits")
        .when((a == "set_uid") & ~F.coalesce(v.rlike("^[0-9]{8,14}$"), F.lit(False)), "uid must be 8 to 14 digits")
    )
    return actions.withColumn("error", error)


def applied(assets: DataFrame, actions: DataFrame) -> DataFrame:
    """The manual columns of assets after a log of actions (target, action, value, at); the last per field wins."""
    good = checked_actions(actions).where("error is null")
    field = (
        F.when(F.col("action") == "set_level", "level").when(F.col("action") == "set_name", "name")
        .when(F.col("action").isin("set_counter", "clear_counter"), "counter").when(F.col("action").isin("reject", "restore"), "rejected")
    )
    last = good.withColumn("field", field).where("field is not null").groupBy("target", "field").agg(F.max_by(F.struct("action", "value"), "at").alias("x"))
    wide = last.groupBy("target").agg(*[F.max(F.when(F.col("field") == f, F.col("x"))).alias(f) for f in ("level", "name", "counter", "rejected")])
    rows = assets.join(wide.withColumnRenamed("target", "id"), "id", "left")
    return rows.select(
        *assets.columns, F.col("level.value").try_cast("int").alias("level_manual"), F.col("name.value").alias("name_manual"),
        F.when(F.col("counter.action") == "set_counter", F.col("counter.value")).alias("counter_manual"),
        F.coalesce(F.col("counter.action") == "clear_counter", F.lit(False)).alias("counter_absent_manual"),
        F.coalesce(F.col("rejected.action") == "reject", F.lit(False)).alias("manual_rejected"),
    )
