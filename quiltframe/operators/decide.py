"""Scores to decisions, gates and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories in the order that breaks ties.
CATEGORIES = ["GUN", "VEHICLE", "OUTFIT", "HELMET", "MASK", "BACKPACK", "ITEM_SET", "EMOTE", "GRENADE", "PARACHUTE", "MISC", "OTHER"]


def category(c: Column) -> Column:
    """Trimmed and upper case; unknown ones are OTHER."""
    up = F.upper(F.trim(c))
    return F.when(up.isin(*CATEGORIES), up).otherwise(F.lit("OTHER"))


def tab_of(y: Column) -> Column:
    """The main tab whose band the indicator (in reference pixels) falls into."""
    return (
        F.when(y.isNull(), "NONE").when(y < 300, "OUTFIT").when(y < 475, "NORMAL_GUN").when(y < 665, "VEHICLE")
        .when(y < 900, "ACCESSORY").when(y < 1150, "MISC").otherwise("OTHER")
    )


def evidence(signals: DataFrame) -> DataFrame:
    """Adds ``scores`` (category to score) to one wide row of signals per screen.

    Signals: main_y, main_rel, sub_y, sub_rel (indicators, null if none), grid, rail, header,
    badge, dark, selector, popup, emote, slots, canopy, ceiling, right_ui, figure, aspect.
    """
    s = {c: F.col(c) for c in signals.columns}
    tab = tab_of(s["main_y"])
    wardrobe = (s["grid"] >= 0.5) & (s["rail"] >= 0.4)
    wearing = tab.isin("OUTFIT", "NONE")
    edge = F.exists(F.array(*[F.lit(float(b)) for b in (300, 475, 665, 900, 1150)]), lambda b: F.abs(s["main_y"] - b) <= 12)
    lab = F.least(F.lit(0.97), 0.7 + 0.27 * (0.35 * s["header"] + 0.35 * s["badge"] + 0.3 * s["dark"]))
    gun = (
        F.when((s["header"] >= 0.4) & (s["badge"] >= 0.4) & (s["dark"] >= 0.4), lab)
        .when((s["dark"] >= 0.4) & ((s["header"] < 0.2) | (s["badge"] < 0.2)), 0.2)
        .otherwise(0.0)
    )
    stock = (tab == "NORMAL_GUN") & (gun < 0.7)
    helmet_zone = wearing & wardrobe & (s["sub_y"] >= 300) & (s["sub_y"] < 450)
    mask_zone = wearing & wardrobe & (s["sub_y"] >= 450) & (s["selector"] < 0.6)
    close = F.abs(s["sub_y"] - 450) <= 15
    h_rel = F.when(s["sub_rel"] >= 0.9, 0.93).otherwise(0.8)
    m_rel = F.when(s["sub_rel"] >= 0.9, 0.91).otherwise(0.78)
    out = F.greatest(
        F.when(wearing & wardrobe & (s["sub_y"].isNull() | (s["sub_y"] < 300)) & (s["popup"] < 0.6), 0.93).otherwise(0.0),
        F.when((s["ceiling"] >= 0.8) & (s["right_ui"] >= 0.25), 0.92)
        .when((s["right_ui"] >= 0.25) & (s["figure"] >= 0.25) & wearing & (s["aspect"] >= 1.6) & ~wardrobe, 0.84)
        .otherwise(0.0),
    )
    acc = tab == "ACCESSORY"
    slots, emote, canopy = s["slots"] >= 0.6, s["emote"] >= 0.6, s["canopy"] >= 0.6
    scores = {
        "GUN": F.when(stock, 0.0).otherwise(gun),
        "VEHICLE": F.when(tab == "VEHICLE", F.when(s["main_rel"] >= 0.9, 0.94).otherwise(0.8) - F.when(edge, 0.15).otherwise(0.0)).otherwise(0.0),
        "OUTFIT": out,
        "HELMET": F.when(helmet_zone, F.when(close, h_rel - 0.12).otherwise(h_rel)).when(mask_zone & close, m_rel - 0.15).otherwise(0.0),
        "MASK": F.when(helmet_zone & close, h_rel - 0.15).when(mask_zone, F.when(close, m_rel - 0.12).otherwise(m_rel)).otherwise(0.0),
        "BACKPACK": F.when(wearing & (s["selector"] >= 0.6), F.when(wardrobe, 0.95).otherwise(0.65)).otherwise(0.0),
        "ITEM_SET": F.when(wearing & wardrobe & (s["popup"] >= 0.6), 0.94).otherwise(0.0),
        "EMOTE": F.when(acc & ~slots & emote, 0.93).otherwise(0.0),
        "GRENADE": F.when(acc & slots, 0.93).otherwise(0.0),
        "PARACHUTE": F.when(acc & ~slots & ~emote & canopy, 0.91).otherwise(0.0),
        "MISC": F.when(tab == "MISC", F.when(s["main_rel"] >= 0.9, 0.88).otherwise(0.75)).when(acc & ~slots & ~emote & ~canopy, 0.6).otherwise(0.0),
        "OTHER": F.when(stock, 0.86).otherwise(0.0),
    }
    most = F.greatest(*scores.values())
    scores["OTHER"] = F.when(most < 0.35, 0.35).otherwise(scores["OTHER"])
    pairs = [x for k, v in scores.items() for x in (F.lit(k), F.coalesce(v.cast("double"), F.lit(0.0)))]
    return signals.withColumn("scores", F.create_map(*pairs))


def decision(df: DataFrame, scope: str, cat: str, score: str, accept: float = 0.85, review: float = 0.55, second: float = 0.4, margin: float = 0.1) -> DataFrame:
    """One row per scope from (scope, category, score) rows: top two, decision and the alternatives of rank 2 to 4 above 0.15."""
    w = Window.partitionBy(scope).orderBy(F.col(score).desc(), F.col(cat))
    ranked = df.withColumn("rank", F.row_number().over(w)).where("rank <= 4")
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    rows = ranked.groupBy(scope).agg(
        pick(1, cat).alias("category"), pick(1, score).alias("confidence"), pick(2, cat).alias("runner_up"), pick(2, score).alias("runner_up_score"),
        F.count_if((F.col("rank") >= 2) & (F.col(score) > 0.15)).alias("alternatives"),
    )
    top, two = F.col("confidence"), F.col("runner_up_score")
    unclear = F.coalesce((top >= review) & (two >= second) & (top - two < margin), F.lit(False))
    return rows.withColumn("decision", F.when(unclear, "REVIEW").when(top >= accept, "AUTO_ACCEPT").when(top >= review, "REVIEW").otherwise("UNKNOWN"))


def card_quality(partial: Column, lock: Column, content: Column) -> Column:
    """Flags and confidence of a card from its three scores."""
    is_partial, is_locked, is_empty = partial >= 0.1, lock >= 0.5, content < 0.35
    unsure = (~is_locked & (lock >= 0.4)) | (~is_empty & (content < 0.45)) | ((partial >= 0.05) & (partial < 0.1))
    sure = F.when(unsure, 0.65).when(is_locked | is_empty | is_partial, 0.9).otherwise(1.0)
    return F.struct(is_locked.alias("locked"), is_empty.alias("empty"), is_partial.alias("partial"), unsure.alias("review_required"), sure.alias("confidence"))


def partial_scores(df: DataFrame, scope: str, w: str = "w", h: str = "h") -> DataFrame:
    """How much a card lacks of its group's median width and 65th percentile height; 0 from 95 % on."""
    norms = df.groupBy(scope).agg(F.median(w).alias("mw"), F.percentile(h, F.lit(0.65)).alias("ph"))
    share = F.least(F.col(w) / F.col("mw"), F.col(h) / F.col("ph"))
    return df.join(norms, scope).withColumn("partial_score", F.when(share < 0.95, 1 - share).otherwise(0.0)).drop("mw", "ph")


def is_active(flags: dict[str, Column]) -> Column:
    """Neither locked, empty, partial, duplicate nor rejected by hand."""
    out = F.lit(True)
    for c in flags.values():
        out = out & ~F.coalesce(c, F.lit(False))
    return out


def routed(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Chooses between a special and a general detector.

    df: special_ok, special_conf, special_n, fallback (recommended), general_ok, general_conf,
    general_n. Adds route, detected and review: special where it is sure; general where special
    failed or asks for it; else the better one, for review.
    """
    special = F.col("special_ok") & (F.col("special_n") > 0)
    general = F.col("general_ok") & (F.col("general_n") > 0)
    failed = ~special | F.col("fallback")
    sure = special & (F.col("special_conf") >= threshold) & ~F.col("fallback")
    route = (
        F.when(sure, "special").when(failed & general, "general").when(failed, "none")
        .when(general & (F.col("general_conf") > F.col("special_conf")), "general").otherwise("special")
    )
    return df.withColumn("route", route).withColumn("detected", F.col("route") != "none").withColumn("review", ~sure)


def gated(rows: DataFrame, sources: DataFrame, key: str, ok: Column) -> DataFrame:
    """Rows whose source passes ``ok``; those of other or unknown sources go."""
    return rows.join(sources.where(ok).select(key).distinct(), key, "left_semi")


def mean_present(*values: Column) -> Column:
    """Mean of the values that are there; 0 without any."""
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)) / n).otherwise(0.0)


def form_for(total: Column, inventory: Column, vehicles: Column) -> Column:
    """The layout form for the counts of an account."""
    return (
        F.when(inventory.between(1, 6) & (total <= 55) & (vehicles <= 12), "classic_small_736")
        .when((total >= 55) | (inventory >= 8) | (vehicles >= 12), "classic_wide").otherwise("classic_compact")
    )


def best_card(boxes: DataFrame, scope: str, min_area: float, fill_most: float = 0.5, aspects: tuple[float, float] = (1.5, 2.5)) -> DataFrame:
    """The outline that is most like a card per screen; boxes: scope, id, w, h, fill. Large ones with an aspect near 2 score high."""
    a = F.col("w") * F.col("h")
    ratio = F.col("w") / F.greatest(F.lit(1), F.col("h"))
    ok = (a >= min_area) & ratio.between(*aspects) & (F.col("fill") <= fill_most)
    score = a * F.greatest(F.lit(0.5), 1 - F.abs(ratio - 2) * 0.4)
    one = boxes.where(ok).withColumn("score", score)
    return one.groupBy(scope).agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))


def selected_item(boxes: DataFrame, scope: str, screen_w: int, min_area: float, strict: tuple[float, float] = (1.75, 2.25), loose: tuple[float, float] = (1.6, 2.4)) -> DataFrame:
    """One box per screen: strict aspects before loose ones, right of a quarter of the screen before the rest, nearest to 2, largest."""
    ratio = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(0.0)
    a = F.col("w") * F.col("h")
    rows = boxes.where((a >= min_area) & ratio.between(*loose)).withColumn("__loose", F.when(ratio.between(*strict), 0).otherwise(1))
    w = Window.partitionBy(scope).orderBy("__loose", F.when(F.col("x") >= 0.25 * screen_w, 0).otherwise(1), F.abs(ratio - 2), -a, "id")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__loose")


def fits_profile(w: Column, h: Column, area: Column, full_w: float, full_h: float, p: dict[str, float]) -> Column:
    """Relative size, aspect and fill of at least 0.6 within a profile (w_min, w_max, h_min, h_max, aspect_min, aspect_max)."""
    ratio = w / F.greatest(F.lit(1), h)
    return (
        w.between(full_w * p["w_min"], full_w * p["w_max"]) & h.between(full_h * p["h_min"], full_h * p["h_max"])
        & ratio.between(p["aspect_min"], p["aspect_max"]) & (area / F.greatest(F.lit(1), w * h) >= 0.6)
    )


def first_signal(signals: list[tuple[str, Column, float]]) -> Column:
    """(signal, confidence) of the first signal that holds."""
    out = F.lit(None).cast("struct<signal:string,confidence:double>")
    for n, c, v in reversed(signals):
        out = F.when(c, F.struct(F.lit(n).alias("signal"), F.lit(v).alias("confidence"))).otherwise(out)
    return out


def chosen_category(manual: Column, cached: Column, machine: Column) -> Column:
    """A person's category before the kept one before the machine's."""
    return F.coalesce(manual, cached, machine)


def dispatched(rows: DataFrame, detectors: DataFrame, default: str) -> DataFrame:
    """Adds the detector of each category (detectors: category, detector; one row per category)."""
    return rows.join(detectors, "category", "left").withColumn("detector", F.coalesce("detector", F.lit(default)))


def assets_of(screens: DataFrame) -> DataFrame:
    """One asset per candidate of a screen (source_id, category, review, candidates: array of (rect, confidence, reasons)).

    A screen under review passes this on to its assets, with a reason.
    """
    c = screens.select("source_id", "category", "review", F.posexplode("candidates").alias("order", "c"))
    reasons = F.when(F.col("review"), F.array_append(F.coalesce("c.reasons", F.array().cast("array<string>")), F.lit("source under review"))).otherwise(F.col("c.reasons"))
    unsure = F.col("review") | (F.col("c.confidence") < 0.6)
    return c.select("source_id", "category", "order", F.col("c.rect").alias("rect"), F.col("c.confidence").alias("confidence"), unsure.alias("review_required"), reasons.alias("reasons"))


def ocr_confidence(level: Column, level_c: Column, name: Column, name_c: Column, counter_c: Column, fallback: Column) -> Column:
    """(confidence, review): mean of the fields that are there; review without level or name, below 0.8 or after a fallback."""
    mean = mean_present(F.when(level.isNotNull(), level_c), F.when(name.isNotNull(), name_c), counter_c)
    return F.struct(mean.alias("confidence"), (level.isNull() | name.isNull() | (mean < 0.8) | fallback).alias("review"))


def version_gate(rows: DataFrame, version: str) -> DataFrame:
    """Rows of another version become errors."""
    stale = F.col("version") != version
    return rows.withColumn("status", F.when(stale, "ERROR").otherwise(F.col("status"))).withColumn("error", F.when(stale, F.concat(F.lit("made by version "), "version")))


def until_sure(rois: DataFrame, scope: str, order: str, confidence: str, sure: float = 0.85) -> DataFrame:
    """Regions up to and with the first one that holds a confidence of at least ``sure``."""
    hit = rois.where(F.col(confidence) >= sure).groupBy(scope).agg(F.min(order).alias("__hit"))
    return rois.join(hit, scope, "left").where(F.col("__hit").isNull() | (F.col(order) <= F.col("__hit"))).drop("__hit")


def digit_of(code: DataFrame, templates: DataFrame, key: str, best: float = 0.105, margin: float = 0.1) -> DataFrame:
    """The digit whose bit template is nearest: closer than ``best`` and by ``margin`` closer than the next digit.

    code: key, bits (array of 0/1). templates: digit, bits; ten to a few dozen rows, broadcast below 1,000.
    """
    t = templates.select("digit", F.col("bits").alias("__t"))
    t = F.broadcast(t) if t.limit(1_001).count() <= 1_000 else t
    apart = F.aggregate(F.zip_with("bits", "__t", lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, v: s + v) / F.size("bits")
    rows = code.join(t, F.size("bits") == F.size("__t")).groupBy(key, "digit").agg(F.min(apart).alias("d"))
    w = Window.partitionBy(key).orderBy("d", "digit")
    top = rows.withColumn("__n", F.row_number().over(w)).withColumn("next", F.lead("d").over(w)).where("__n = 1")
    ok = (F.col("d") < best) & (F.coalesce("next", F.lit(1.0)) - F.col("d") > margin)
    return top.select(key, F.when(ok, F.col("digit")).alias("digit"), "d")


def is_ocr_target(category: Column, locked: Column, empty: Column, partial: Column, duplicate: Column) -> Column:
    """Guns worth reading; those rejected by hand are read as well."""
    return (category == "GUN") & is_active({"locked": locked, "empty": empty, "partial": partial, "duplicate": duplicate})


def row_status(name: Column, level: Column, failed: Column) -> Column:
    """(missing, failed) of a row of the simple list: no name by hand or machine, no level or an error."""
    return F.struct((name.isNull() | (F.trim(name) == "")).alias("missing"), (F.coalesce(failed, F.lit(False)) | level.isNull()).alias("failed"))


def odd_size(n: Column) -> Column:
    """A filter size: at least 1 and odd."""
    k = F.greatest(F.lit(1), F.coalesce(n, F.lit(1)))
    return F.when(k % 2 == 0, k + 1).otherwise(k)


def odd_or_none(n: Column) -> Column:
    """A filter size as it was given: odd, the next one if even; null if it is not positive or not a number."""
    k = n.try_cast("int")
    return F.when(k > 0, F.when(k % 2 == 1, k).otherwise(k + 1))


def filter_sizes(widest: Column, narrowest: Column, default: int = 3) -> Column:
    """(maximum, minimum): one of the two filters, the maximum before the minimum; the default maximum if neither is given."""
    most, least = odd_or_none(widest), odd_or_none(narrowest)
    both = F.when(most.isNotNull(), F.lit(None).cast("int")).otherwise(least)
    return F.struct(F.when(most.isNull() & both.isNull(), F.lit(default)).otherwise(most).alias("maximum"), both.alias("minimum"))


def merged_reasons(old: Column, new: Column) -> Column:
    """The old reasons and those of the new that aren't among them, each once, in order."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(old, none), F.coalesce(new, none))


def confirmed_title(full_lv: Column, full_c: Column, suffix_lv: Column, suffix_c: Column) -> Column:
    """(lv, confidence) of a title that a second crop confirms: the same level, confidences of at least 0.45 and 0.55."""
    ok = full_lv.isNotNull() & (full_c >= 0.45) & (full_lv == suffix_lv) & (suffix_c >= 0.55)
    return F.when(ok, F.struct(full_lv.alias("lv"), F.round(100 * F.least(full_c, suffix_c), 1).alias("confidence")))


def cascade(readings: DataFrame, scope: str, order: str, lv: str, confidence: str, sure: float = 70.0) -> DataFrame:
    """The reading of the first region that is sure, else the first that says anything: regions after a sure one are not asked."""
    asked = until_sure(readings.where(F.col(lv).isNotNull()), scope, order, confidence, sure)
    place = F.struct(F.when(F.col(confidence) >= sure, 0).otherwise(1), F.col(order))
    return asked.groupBy(scope).agg(F.min_by(F.struct(lv, confidence, order), place).alias("r")).select(scope, "r.*")


def accepted_matches(matches: DataFrame, scope: str, most: float = 12.0) -> DataFrame:
    """Places of cut-out images on their reference (scope, id, column, y, difference), numbered row by row.

    All of a reference's matches are refused where two share a place or one differs by more than ``most``.
    """
    w = Window.partitionBy(scope)
    bad = F.max("difference").over(w) > most
    rows = matches.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy(scope, "column", "y")))
    rows = rows.withColumn("refused", bad | (F.max("__same").over(w) > 1)).drop("__same")
    place = F.row_number().over(w.orderBy("y", "column", "id")) - 1
    return rows.withColumn("place", F.when(~F.col("refused"), place))


class Detectors:
    """Named and versioned functions from screens to candidates; each category has one, the rest go to the default."""

    def __init__(self, default: str):
        self.default, self.known, self.of = default, {}, {}

    def add(self, name: str, version: str, detect, *categories: str) -> None:
        self.known[name] = (version, detect)
        self.of.update(dict.fromkeys(categories, name))

    def run(self, screens: DataFrame) -> DataFrame:
        """The candidates of all screens (category and what the detectors need), with detector and version."""
        missing = {*self.of.values(), self.default} - set(self.known)
        if missing:
            raise ValueError(f"no detector {sorted(missing)}")
        out = None
        for name, (version, detect) in self.known.items():
            mine = [c for c, n in self.of.items() if n == name]
            chosen = F.col("category").isin(mine) if mine else F.lit(False)
            if name == self.default:
                chosen |= F.col("category").isNull() | ~F.col("category").isin(list(self.of))
            part = detect(screens.where(chosen)).withColumns({"detector": F.lit(name), "version": F.lit(version)})
            out = part if out is None else out.unionByName(part)
        return out


def rhythm(values: DataFrame, scope: str, at: str, value: str, period: int) -> DataFrame:
    """The phase of ``period`` whose values have the largest mean, the least phase on ties."""
    phases = values.groupBy(scope, (F.col(at) % period).alias("phase")).agg(F.avg(value).alias("mean"))
    return phases.groupBy(scope).agg(F.max_by("phase", F.struct("mean", -F.col("phase"))).alias("phase"), F.max("mean").alias("mean"))
