"""One query per operator on the relational tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiltframe.functions import geometry as G
from quiltframe.functions import dates, keys, text
from quiltframe.operators import consensus, decide, dedup, layout, ordering, overrides, review, tallies
from quiltframe.sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- agreement ---------------------------------------------------------------------------------

CONSENSUS = """
WITH g AS (SELECT l_orderkey, l_returnflag, max(l_quantity / 50) AS m, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, least(1.0::DOUBLE, m + 0.05::DOUBLE * (n - 1)) AS c FROM g),
r AS (SELECT *, row_number() OVER w AS place, lead(c) OVER w AS runner FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY c DESC, n DESC, l_returnflag))
SELECT l_orderkey, l_returnflag AS best, c AS confidence, n AS sources, coalesce(runner >= 0.5::DOUBLE, false) AS has_conflict,
  CASE WHEN NOT coalesce(runner >= 0.5::DOUBLE, false) AND c >= 0.8::DOUBLE THEN l_returnflag END AS accepted,
  coalesce(runner >= 0.5::DOUBLE, false) OR c < 0.8::DOUBLE AS review_required FROM r WHERE place = 1
"""


@query(CONSENSUS)
def agg7_consensus_lineitem(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", (F.col("l_quantity") / 50).alias("c"))
    return consensus.consensus(rows, "l_orderkey", "l_returnflag", "l_linenumber", "c")


@query(f"SELECT count(*) AS scopes, count(accepted) AS accepted, count(*) FILTER (WHERE has_conflict) AS conflicts, count(*) FILTER (WHERE review_required) AS reviews FROM ({CONSENSUS})")
def agg8_consensus_writeback(spark, d):
    c = agg7_consensus_lineitem(spark, d)
    return c.agg(F.count(F.lit(1)).alias("scopes"), F.count("accepted").alias("accepted"), F.count_if("has_conflict").alias("conflicts"), F.count_if("review_required").alias("reviews"))


@query("""
WITH g AS (SELECT l_orderkey AS k, l_returnflag || '/' || l_linestatus AS v, count(*) AS votes, max(l_quantity * 2) AS best FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS place, lead(votes) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY k ORDER BY votes DESC, v))
SELECT k, CASE WHEN votes >= 2 AND best >= 55 AND NOT coalesce(nxt = votes, false) THEN v END AS winner, votes,
  votes >= 2 AND best >= 55 AND NOT coalesce(nxt = votes, false) AS confirmed FROM r WHERE place = 1
""")
def agg9_progress_vote(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("v"), (F.col("l_quantity") * 2).alias("c"))
    return consensus.progress_vote(rows, "k", "v", "c")


@query("""
WITH g AS (SELECT l_orderkey AS k, l_linenumber AS v, count(*) AS votes, max(l_quantity * 2) AS best FROM (SELECT l_orderkey // 4 AS l_orderkey, l_linenumber, l_quantity FROM lineitem)
  WHERE l_linenumber BETWEEN 1 AND 20 AND l_quantity * 2 >= 45 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS place, lead(best) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY k ORDER BY votes DESC, v))
SELECT k, CASE WHEN votes >= 2 AND best >= 65 AND NOT coalesce(nxt >= 65, false) THEN v END AS winner, votes,
  votes >= 2 AND best >= 65 AND NOT coalesce(nxt >= 65, false) AS confirmed FROM r WHERE place = 1
""")
def agg10_title_vote(spark, d):
    rows = t(spark, d, "lineitem").select(F.expr("l_orderkey div 4").alias("k"), F.col("l_linenumber").alias("v"), (F.col("l_quantity") * 2).alias("c"))
    return consensus.title_vote(rows, "k", "v", "c")


# -- tallies -----------------------------------------------------------------------------------

@query("""
SELECT v AS category, coalesce(n, 0) AS n FROM (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','OTHER']) AS v)
LEFT JOIN (SELECT CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW') THEN o_orderpriority ELSE 'OTHER' END AS c, count(*) AS n FROM orders GROUP BY 1) ON c = v
""")
def agg1_tally_orders(spark, d):
    return tallies.tally(t(spark, d, "orders"), F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("""
SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines,
 count(*) FILTER (WHERE l_discount >= 0.05::DOUBLE) AS discounted, count(*) FILTER (WHERE l_quantity < 10) AS small FROM lineitem GROUP BY 1
""")
def agg2_summary_lineitem(spark, d):
    c = F.col
    rows = t(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate").cast("string"))
    return tallies.counts(rows, ["day"], returned=c("l_returnflag") == "R", open_lines=c("l_linestatus") == "O", discounted=c("l_discount") >= 0.05, small=c("l_quantity") < 10)


@query("SELECT event_type, avg(value) AS mean, median(value) AS median, quantile_cont(value, 0.95) AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def agg14_latency_report(spark, d):
    return tallies.latencies(t(spark, d, "events"), "event_type", "value")


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS types, quantile_disc(p_size, 0.5) AS lower_mid, list_sort(list(p_size))[count(*) // 2 + 1] AS upper_mid FROM part GROUP BY 1")
def agg11_upper_median_part(spark, d):
    sizes = F.array_sort(F.collect_list("p_size"))
    return t(spark, d, "part").groupBy("p_brand").agg(
        F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"),
        F.element_at(sizes, (F.floor((F.count(F.lit(1)) - 1) / 2) + 1).cast("int")).alias("lower_mid"),
        tallies.upper_median(F.collect_list("p_size")).alias("upper_mid"),
    )


# -- decisions ---------------------------------------------------------------------------------

@query("""
WITH s AS (SELECT user_id, event_type, least(1.0::DOUBLE, max(value) / 100) AS score FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS k FROM s),
p AS (SELECT user_id, max(CASE WHEN k = 1 THEN event_type END) AS category, max(CASE WHEN k = 1 THEN score END) AS confidence, max(CASE WHEN k = 2 THEN event_type END) AS runner_up,
 max(CASE WHEN k = 2 THEN score END) AS runner_up_score, count(*) FILTER (WHERE k BETWEEN 2 AND 4 AND score > 0.15::DOUBLE) AS alternatives FROM r GROUP BY 1)
SELECT *, CASE WHEN coalesce(confidence >= 0.55::DOUBLE AND runner_up_score >= 0.4::DOUBLE AND confidence - runner_up_score < 0.1::DOUBLE, false) THEN 'REVIEW'
 WHEN confidence >= 0.85::DOUBLE THEN 'AUTO_ACCEPT' WHEN confidence >= 0.55::DOUBLE THEN 'REVIEW' ELSE 'UNKNOWN' END AS decision FROM p
""")
def dec2_decision_events(spark, d):
    s = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.least(F.lit(1.0), F.max("value") / 100).alias("score"))
    return decide.decision(s, "user_id", "event_type", "score")


SIGNALS = [("main_y", 7, 1300), ("main_rel", 11, 100), ("sub_y", 13, 600), ("sub_rel", 17, 100), ("grid", 19, 100), ("rail", 23, 100), ("header", 29, 100), ("badge", 31, 100), ("dark", 37, 100), ("selector", 41, 100), ("popup", 43, 100), ("emote", 47, 100), ("slots", 53, 100), ("canopy", 59, 100), ("ceiling", 61, 100), ("right_ui", 67, 100), ("figure", 71, 100)]
_S = ", ".join(f"CASE WHEN '{n}' IN ('main_y', 'sub_y') AND (o_orderkey * {m}) % 5 = 0 THEN NULL ELSE ((o_orderkey * {m}) % {k})::DOUBLE / {1 if k > 100 else 100} END AS {n}" for n, m, k in SIGNALS)


def _signals(spark, d) -> DataFrame:
    k, cols = F.col("o_orderkey"), []
    for n, m, top in SIGNALS:
        v = ((k * m) % top).cast("double") / (1 if top > 100 else 100)
        cols.append((F.when((k * m) % 5 != 0, v) if n in ("main_y", "sub_y") else v).alias(n))
    return t(spark, d, "orders").select("o_orderkey", *cols, (1.5 + (k % 3) * 0.25).alias("aspect"))


@query(f"""
WITH s AS (SELECT o_orderkey, {_S}, 1.5::DOUBLE + (o_orderkey % 3) * 0.25::DOUBLE AS aspect FROM orders),
a AS (SELECT *, CASE WHEN main_y IS NULL THEN 'NONE' WHEN main_y < 300 THEN 'OUTFIT' WHEN main_y < 475 THEN 'NORMAL_GUN' WHEN main_y < 665 THEN 'VEHICLE' WHEN main_y < 900 THEN 'ACCESSORY' WHEN main_y < 1150 THEN 'MISC' ELSE 'OTHER' END AS tab,
 grid >= 0.5::DOUBLE AND rail >= 0.4::DOUBLE AS wr FROM s),
b AS (SELECT *, tab IN ('OUTFIT', 'NONE') AS wear, CASE WHEN header >= 0.4::DOUBLE AND badge >= 0.4::DOUBLE AND dark >= 0.4::DOUBLE THEN least(0.97::DOUBLE, 0.7::DOUBLE + 0.27::DOUBLE * (0.35::DOUBLE * header + 0.35::DOUBLE * badge + 0.3::DOUBLE * dark))
 WHEN dark >= 0.4::DOUBLE AND (header < 0.2::DOUBLE OR badge < 0.2::DOUBLE) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS g FROM a),
c AS (SELECT o_orderkey,
 CASE WHEN tab = 'NORMAL_GUN' AND g < 0.7::DOUBLE THEN 0.0::DOUBLE ELSE g END AS gun,
 CASE WHEN tab = 'VEHICLE' THEN CASE WHEN main_rel >= 0.9::DOUBLE THEN 0.94::DOUBLE ELSE 0.8::DOUBLE END - CASE WHEN abs(main_y - 300) <= 12 OR abs(main_y - 475) <= 12 OR abs(main_y - 665) <= 12 OR abs(main_y - 900) <= 12 OR abs(main_y - 1150) <= 12 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS vehicle,
 CASE WHEN wear AND selector >= 0.6::DOUBLE THEN CASE WHEN wr THEN 0.95::DOUBLE ELSE 0.65::DOUBLE END ELSE 0.0::DOUBLE END AS backpack,
 CASE WHEN tab = 'MISC' THEN CASE WHEN main_rel >= 0.9::DOUBLE THEN 0.88::DOUBLE ELSE 0.75::DOUBLE END WHEN tab = 'ACCESSORY' AND slots < 0.6::DOUBLE AND emote < 0.6::DOUBLE AND canopy < 0.6::DOUBLE THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS misc,
 CASE WHEN tab = 'ACCESSORY' AND slots >= 0.6::DOUBLE THEN 0.93::DOUBLE ELSE 0.0::DOUBLE END AS grenade FROM b)
SELECT * FROM c
""")
def dec1_evidence_orders(spark, d):
    e = decide.evidence(_signals(spark, d))
    return e.select("o_orderkey", *[F.col("scores")[c.upper()].alias(c) for c in ("gun", "vehicle", "backpack", "misc", "grenade")])


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_tax AS partial, l_discount * 6 AS lk, l_quantity / 50 AS content FROM lineitem),
f AS (SELECT *, partial >= 0.1::DOUBLE AS p, lk >= 0.5::DOUBLE AS l, content < 0.35::DOUBLE AS e FROM s),
u AS (SELECT *, (NOT l AND lk >= 0.4::DOUBLE) OR (NOT e AND content < 0.45::DOUBLE) OR (partial >= 0.05::DOUBLE AND partial < 0.1::DOUBLE) AS unsure FROM f)
SELECT l_orderkey, l_linenumber, l AS locked, e AS empty, p AS partial, unsure AS review_required, CASE WHEN unsure THEN 0.65::DOUBLE WHEN l OR e OR p THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM u
""")
def dec6_card_quality(spark, d):
    q = decide.card_quality(F.col("l_tax"), F.col("l_discount") * 6, F.col("l_quantity") / 50)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q")).select("l_orderkey", "l_linenumber", "q.*")


@query("""
WITH m AS (SELECT p_brand, median(p_size) AS mw, quantile_cont(p_retailprice, 0.65) AS ph FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN least(p_size / mw, p_retailprice / ph) < 0.95::DOUBLE THEN 1 - least(p_size / mw, p_retailprice / ph) ELSE 0.0::DOUBLE END AS partial_score FROM part JOIN m USING (p_brand)
""")
def dec7_partial_scores(spark, d):
    return decide.partial_scores(t(spark, d, "part"), "p_brand", "p_size", "p_retailprice").select("p_partkey", "partial_score")


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 3 > 0 AS sok, (o_orderkey % 101) / 100.0::DOUBLE AS sc, o_orderkey % 7 AS sn, o_orderkey % 11 = 0 AS fb, o_orderkey % 4 > 0 AS gok, (o_orderkey % 97) / 100.0::DOUBLE AS gc, o_orderkey % 5 AS gn FROM orders),
x AS (SELECT *, sok AND sn > 0 AS s, gok AND gn > 0 AS g FROM r),
y AS (SELECT *, NOT s OR fb AS failed, s AND sc >= 0.6::DOUBLE AND NOT fb AS sure FROM x)
SELECT o_orderkey, CASE WHEN sure THEN 'special' WHEN failed AND g THEN 'general' WHEN failed THEN 'none' WHEN g AND gc > sc THEN 'general' ELSE 'special' END AS route,
 NOT (NOT sure AND failed AND NOT g) AS detected, NOT sure AS review FROM y
""")
def dec4_routed(spark, d):
    k = F.col("o_orderkey")
    rows = t(spark, d, "orders").select(
        k, (k % 3 > 0).alias("special_ok"), ((k % 101) / 100).alias("special_conf"), (k % 7).alias("special_n"), (k % 11 == 0).alias("fallback"),
        (k % 4 > 0).alias("general_ok"), ((k % 97) / 100).alias("general_conf"), (k % 5).alias("general_n"),
    )
    return decide.routed(rows).select("o_orderkey", "route", "detected", "review")


@query("SELECT c_custkey, CASE WHEN upper(trim(c_mktsegment)) IN ('MISC', 'GUN') THEN upper(trim(c_mktsegment)) ELSE 'OTHER' END AS category FROM customer")
def prj8_category(spark, d):
    return t(spark, d, "customer").select("c_custkey", decide.category(F.col("c_mktsegment")).alias("category"))


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey")
def flt2_gate_lineitem(spark, d):
    orders = t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return decide.gated(t(spark, d, "lineitem"), orders, "l_orderkey", F.col("o_orderstatus") != "P").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_linestatus = 'O' OR l_discount > 0.08::DOUBLE)")
def flt1_active(spark, d):
    c = F.col
    ok = decide.is_active({"locked": c("l_returnflag") == "R", "empty": c("l_linestatus") == "O", "partial": c("l_discount") > 0.08})
    return t(spark, d, "lineitem").where(ok).select("l_orderkey", "l_linenumber")


@query("""
SELECT o_custkey AS k, CASE WHEN i BETWEEN 1 AND 6 AND n <= 55 AND v <= 12 THEN 'classic_small_736' WHEN n >= 55 OR i >= 8 OR v >= 12 THEN 'classic_wide' ELSE 'classic_compact' END AS form
FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS i, count(*) FILTER (WHERE o_orderstatus = 'F') AS v FROM orders GROUP BY 1)
""")
def dec11_form(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("i"), F.count_if(F.col("o_orderstatus") == "F").alias("v"))
    return n.select("k", decide.form_for(F.col("n"), F.col("i"), F.col("v")).alias("form"))


# -- duplicates --------------------------------------------------------------------------------

@query("SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars, doc_id) = 1 AS is_first FROM documents")
def win1_first_seen_documents(spark, d):
    return dedup.first_seen(t(spark, d, "documents"), F.col("text"), ["n_chars"], "doc_id").select("doc_id", "sha256", "is_first")


def _signs(df: DataFrame) -> DataFrame:
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 64), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return df.select("vec_id", "label", bits.alias("code"), "embedding")


SIGNS_SQL = "SELECT vec_id, label, list_sum([CASE WHEN embedding[i] > 0 AND i < 64 THEN (1::HUGEINT << (i - 1)::INTEGER) WHEN embedding[i] > 0 THEN -(1::HUGEINT << 63) ELSE 0::HUGEINT END FOR i IN range(1, 65)])::BIGINT AS code FROM embeddings"


@query(f"WITH e AS ({SIGNS_SQL}) SELECT a.label, a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.code, b.code))::INTEGER AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND bit_count(xor(a.code, b.code)) <= 20")
def jn8_near_pairs_embeddings(spark, d):
    return dedup.near_pairs(_signs(t(spark, d, "embeddings")), "vec_id", "label", "code", 20)


#: The bound on 25 times the MAE of z-scored vectors. The reference's 12 leaves none of the pairs of these tables, as its 10 bits do.
VERIFIED = 24.0


@query(f"""
WITH e AS ({SIGNS_SQL}),
z AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_avg(embedding::DOUBLE[]) AS m, list_stddev_pop(embedding::DOUBLE[]) AS s FROM embeddings),
n AS (SELECT e.*, [(x - m) / CASE WHEN s > 1e-4 THEN s ELSE 1 END FOR x IN v] AS v FROM e JOIN z USING (vec_id))
SELECT a.label, a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.code, b.code))::INTEGER AS distance FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id
  AND bit_count(xor(a.code, b.code)) <= 20 AND list_avg([abs(a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)]) * 25 < {VERIFIED}
""")
def jn8_verified_pairs_embeddings(spark, d):
    return dedup.near_pairs(_signs(t(spark, d, "embeddings")), "vec_id", "label", "code", 20, "embedding", VERIFIED)


#: Codes of parts: groups of nine share all bits but one to three; what they show differs by size.
CODES = "SELECT p_partkey AS id, p_partkey % 5 AS scope, xor(p_partkey // 45 * 88888888888 % 1000000007 * 4611686, (1::BIGINT << (p_partkey % 31)::INTEGER) + (p_partkey // 5 % 2)) AS code, [p_size, p_size % 7, p_size % 3, 1, 2, 3]::DOUBLE[] AS v FROM part"


def _codes(spark, d) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    group = F.floor(k / 45) * 88888888888 % 1000000007 * 4611686
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), (k % 31).cast("int")) + F.floor(k / 5) % 2
    v = F.array(*[x.cast("double") for x in (n, n % 7, n % 3, F.lit(1), F.lit(2), F.lit(3))])
    return t(spark, d, "part").select(k.alias("id"), (k % 5).alias("scope"), group.bitwiseXOR(flip).alias("code"), v.alias("v"))


@query(f"""
WITH c AS ({CODES}), z AS (SELECT *, list_avg(v) AS m, list_stddev_pop(v) AS s FROM c), n AS (SELECT id, scope, code, [(x - m) / CASE WHEN s > 1e-4 THEN s ELSE 1 END FOR x IN v] AS v FROM z)
SELECT a.scope, a.id AS a, b.id AS b, bit_count(xor(a.code, b.code))::INTEGER AS distance FROM n a JOIN n b ON a.scope = b.scope AND a.id < b.id
  AND bit_count(xor(a.code, b.code)) <= 3 AND list_avg([abs(a.v[i] - b.v[i]) FOR i IN range(1, 7)]) * 25 < 12
""")
def jn8_near_parts(spark, d):
    """The usual bounds: 3 bits and 12 for 25 times the MAE."""
    return dedup.near_pairs(_codes(spark, d), "id", "scope", "code", 3, "v", 12.0)


@query()
def win4_canonical_parts(spark, d):
    c = _codes(spark, d).withColumn("eligible", F.col("id") % 7 != 0)
    pairs = dedup.near_pairs(c, "id", "scope", "code", 3, "v", 12.0)
    return dedup.canonicals(c.withColumn("place", -F.col("id")), pairs, "scope", "id", "place", "eligible")


@query()
def win4_canonicals_embeddings(spark, d):
    e = _signs(t(spark, d, "embeddings")).withColumn("eligible", F.col("vec_id") % 7 != 0)
    pairs = dedup.near_pairs(e, "vec_id", "label", "code", 22, "embedding", VERIFIED)
    return dedup.canonicals(e.withColumn("place", F.col("vec_id")), pairs, "label", "vec_id", "place", "eligible")


@query("SELECT count(*) AS pairs, sum(bit_count(xor(a.o_orderkey * 7919, b.o_orderkey * 104729))) AS bits FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def mth1_hamming_orders(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    return o.select((F.col("o_orderkey") + 1).alias("k"), F.col("o_orderkey").alias("a")).join(o, F.col("k") == F.col("o_orderkey")).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(keys.hamming(F.col("a") * 7919, F.col("o_orderkey") * 104729)).alias("bits")
    )


@query("SELECT a.vec_id, list_sum([abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) FOR i IN range(1, len(a.embedding) + 1)]) / len(a.embedding) AS mae FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mth2_mae_embeddings(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(n, "vec_id").select("vec_id", dedup.mae(F.col("v"), F.col("w")).alias("mae"))


# -- overrides ---------------------------------------------------------------------------------

@query("""
SELECT doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'junk' END, source) AS category, l.doc_id IS NOT NULL AS labelled FROM documents LEFT JOIN labels l USING (doc_id)
""")
def prj6_effective_category(spark, d):
    labels = t(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("has"))
    rows = t(spark, d, "documents").join(labels, "doc_id", "left")
    return rows.select("doc_id", overrides.effective(F.when(F.col("quality") == 0, "junk"), F.col("source")).alias("category"), F.coalesce("has", F.lit(False)).alias("labelled"))


@query("""
SELECT p_name AS name, CASE WHEN sha256(p_brand) = sha256(CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_brand END) AND p_partkey % 3 < 2 AND p_partkey % 2 = 0 THEN 'c' || (p_partkey % 3) ELSE 'none' END AS choice, p_partkey FROM part
""")
def jn10_guarded_choice(spark, d):
    p = t(spark, d, "part")
    items = p.select(F.col("p_partkey"), F.col("p_name").alias("label"), F.col("p_partkey").cast("string").alias("name"), F.sha2("p_brand", 256).alias("sha256"))
    k = F.col("p_partkey")
    saved = p.where(k % 2 == 0).select(k.cast("string").alias("name"), F.sha2(F.when(k % 5 == 0, "x").otherwise(F.col("p_brand")), 256).alias("sha256"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("choice"))
    return overrides.guarded_choice(items, saved, ["c0", "c1"], "none").select(F.col("label").alias("name"), "choice", "p_partkey")


# an order repeats line numbers, so a line is named by its part, supplier and quantity too
BOXES = "SELECT l_orderkey AS source, l_linenumber::BIGINT * 1000000000000 + l_partkey * 10000000 + l_suppkey * 100 + l_quantity::BIGINT AS id, l_returnflag AS category, (l_partkey % 400)::INTEGER AS x, (l_suppkey % 300)::INTEGER AS y, (40 + l_quantity)::INTEGER AS w, (40 + l_quantity)::INTEGER AS h FROM lineitem"


def _boxes(spark, d) -> DataFrame:
    q = (40 + F.col("l_quantity")).cast("int")
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**7 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("id"), F.col("l_returnflag").alias("category"), G.rect(F.col("l_partkey") % 400, F.col("l_suppkey") % 300, q, q).alias("rect"))


# old rows: same id for every seventh, else a shifted box under another id; orders of one line have a lone pair, moved far away
OLD_BOXES = f"SELECT source, CASE WHEN (source + id) % 7 = 0 THEN id ELSE id + 100000000000000 END AS id, category, CASE WHEN source % 3 = 0 THEN x + 500 ELSE x + 3 END AS x, y + 2 AS y, w, h FROM ({BOXES}) WHERE id % 2 = 1"


@query(f"""
WITH n AS ({BOXES}), o AS ({OLD_BOXES}),
m AS (SELECT n.source, n.id, o.id AS old_id, greatest(0, least(n.x + n.w, o.x + o.w) - greatest(n.x, o.x))::BIGINT * greatest(0, least(n.y + n.h, o.y + o.h) - greatest(n.y, o.y)) AS i, n.w * n.h + o.w * o.h AS s FROM n JOIN o USING (source, category)),
b AS (SELECT source, id, list(old_id ORDER BY i::DOUBLE / (s - i) DESC, old_id)[1] AS old_id FROM m WHERE i::DOUBLE / (s - i) >= 0.7::DOUBLE GROUP BY source, id),
k AS (SELECT source, count(*) AS news FROM n GROUP BY 1), l AS (SELECT source, count(*) AS olds, min(id) AS old_id, min(category) AS category FROM o GROUP BY 1)
SELECT n.source, n.id, coalesce(e.id, b.old_id, CASE WHEN news = 1 AND olds = 1 AND l.category = n.category THEN l.old_id END) AS old_id
FROM n JOIN k USING (source) LEFT JOIN o e ON e.source = n.source AND e.id = n.id LEFT JOIN b ON b.source = n.source AND b.id = n.id LEFT JOIN l ON l.source = n.source
""")
def jn3_carried_over(spark, d):
    new = _boxes(spark, d)
    r, k, i = F.col("rect"), F.col("source"), F.col("id")
    old = new.where("id % 2 = 1").select("source", F.when((k + i) % 7 == 0, i).otherwise(i + 10**14).alias("id"), "category", G.rect(F.when(k % 3 == 0, r["x"] + 500).otherwise(r["x"] + 3), r["y"] + 2, r["w"], r["h"]).alias("rect"))
    return overrides.carried_over(new, old)


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def st7_latest_action(spark, d):
    return overrides.latest(t(spark, d, "events"), ["user_id", "event_type"], "event_id", "value")


@query("""
SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN o.v IS NULL THEN 'new' WHEN n.v IS NULL THEN 'kept' WHEN n.v = o.v THEN 'same' ELSE 'changed' END AS state, o.v IS NOT NULL AND n.v IS NOT NULL AND n.v <> o.v AS stale
FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 4 > 0) n FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'OLD' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 > 0) o ON n.k = o.k
""")
def st1_merged_sources(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    new = c.where(k % 4 > 0).select(k.alias("k"), F.col("c_mktsegment").alias("v"))
    old = c.where(k % 5 > 0).select(k.alias("k"), F.when(k % 3 == 0, "OLD").otherwise(F.col("c_mktsegment")).alias("v"))
    return overrides.merged_sources(old, new, "k", "v")


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def st12_to_compute(spark, d):
    done = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return overrides.to_compute(t(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_custkey"])


# -- geometry ----------------------------------------------------------------------------------

@query(f"SELECT source, id, x + w AS r, y + h AS b, w::BIGINT * h AS area, w::DOUBLE / h AS aspect, greatest(0, least(x + w, 320) - least(x, 320)) AS cw, greatest(0, least(y + h, 240) - least(y, 240)) AS ch, round_even(x * 0.5::DOUBLE, 0)::INTEGER AS sx, round_even(w * 0.3::DOUBLE, 0)::INTEGER AS sw FROM ({BOXES})")
def prj1_rect_columns(spark, d):
    r = F.col("rect")
    c, s = G.clamp(r, F.lit(320), F.lit(240)), G.scale(r, F.lit(0.5), F.lit(0.5))
    return _boxes(spark, d).select("source", "id", G.right(r).alias("r"), G.bottom(r).alias("b"), G.area(r).alias("area"), G.aspect(r).alias("aspect"), c["w"].alias("cw"), c["h"].alias("ch"), s["x"].alias("sx"), G.scale(r, F.lit(0.3), F.lit(0.3))["w"].alias("sw"))


@query(f"WITH b AS ({BOXES}) SELECT a.source, a.id AS a, c.id AS b, (least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x))::BIGINT * (least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS shared FROM b a JOIN b c ON a.source = c.source AND a.id < c.id AND least(a.x + a.w, c.x + c.w) > greatest(a.x, c.x) AND least(a.y + a.h, c.y + c.h) > greatest(a.y, c.y)")
def jn4_overlaps(spark, d):
    from quiltframe.operators.boxes import overlaps

    return overlaps(_boxes(spark, d), "source")


@query(f"SELECT source, id FROM ({BOXES}) WHERE x >= 50 AND y >= 50 AND x + w <= 350 AND y + h <= 250")
def jn5_inside(spark, d):
    return _boxes(spark, d).where(G.inside(F.col("rect"), G.rect(F.lit(50), F.lit(50), F.lit(300), F.lit(200)))).select("source", "id")


@query("""
WITH b AS (SELECT l_orderkey AS src, l_linenumber AS id, l_linenumber % 2 = 1 AS lab, (l_partkey % 600)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, (20 + l_quantity)::DOUBLE AS w, 12.0::DOUBLE AS h FROM lineitem)
SELECT a.src, a.id AS label_id, c.id AS digit_id FROM b a JOIN b c ON a.src = c.src AND a.lab AND NOT c.lab AND c.x - (a.x + a.w) BETWEEN -5 AND greatest(40.0::DOUBLE, 4.5::DOUBLE * a.h) AND abs((c.y + c.h / 2) - (a.y + a.h / 2)) <= greatest(10.0::DOUBLE, 0.85::DOUBLE * a.h)
""")
def jn6_split_boxes(spark, d):
    from quiltframe.operators.boxes import split_pairs

    c = F.col
    b = t(spark, d, "lineitem").select(c("l_orderkey").alias("src"), c("l_linenumber").alias("id"), (c("l_linenumber") % 2 == 1).alias("lab"), (c("l_partkey") % 600).cast("double").alias("x"), (c("l_suppkey") % 40).cast("double").alias("y"), (20 + c("l_quantity")).alias("w"), F.lit(12.0).alias("h"))
    return split_pairs(b.where("lab"), b.where("not lab"), "src").select("src", "label_id", "digit_id")


# -- order -------------------------------------------------------------------------------------

@query("""
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY -p_size, CASE WHEN p_retailprice > 1500 THEN 0 ELSE 1 END, p_type, p_partkey) - 1 AS place FROM part
""")
def srt3_part_order(spark, d):
    from quiltframe.operators.ordering import gun_order

    p = t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").alias("level"), (F.col("p_retailprice") > 1500).alias("has_counter"), F.lit(0).alias("rank"), F.col("p_type").alias("family"), F.lit(False).alias("special"), F.lit(False).alias("converted"), F.lit(False).alias("blue"), F.col("p_partkey").alias("i"))
    return p.select("p_partkey", (F.row_number().over(Window.partitionBy("p_brand").orderBy(*gun_order())) - 1).alias("place"))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part) WHERE k <= 9")
def top1_nine_per_brand(spark, d):
    return ordering.first_of_each(t(spark, d, "part"), "p_brand", ["p_size", "p_partkey"], 9).select("p_brand", "p_partkey")


@query("""
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN c LIKE 'ticket_3%' THEN 0 WHEN c LIKE 'ticket_%' THEN 1 WHEN c = 'vip' THEN 2 ELSE 3 END, CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END, s_name) - 1 AS place
FROM (SELECT *, ['ticket_3', 'ticket_1', 'vip', 'none'][s_suppkey % 4 + 1] AS c FROM supplier)
""")
def srt5_vehicle_order(spark, d):
    from quiltframe.operators.ordering import vehicle_order

    c = F.element_at(F.array(*[F.lit(x) for x in ("ticket_3", "ticket_1", "vip", "none")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", c.alias("choice"), (F.col("s_acctbal") > 5000).alias("red"), F.col("s_name").alias("name"))
    return s.select("s_suppkey", (F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*vehicle_order())) - 1).alias("place"))


# -- text --------------------------------------------------------------------------------------

@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, ['Lv ', 'x', '', 'I'][l_linenumber % 4 + 1] AS p, CASE WHEN l_linenumber % 4 = 3 THEN 1 ELSE l_linenumber END AS c, (l_quantity::INTEGER % 9) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN CASE WHEN c = 3 AND m = 3 THEN 4 ELSE c END END AS lv FROM (SELECT *, p <> 'x' AND c BETWEEN 1 AND m AND m <= 20 AS ok FROM s)
""")
def str2_progress_lineitem(spark, d):
    n = F.col("l_linenumber")
    x = F.element_at(F.array(*[F.lit(v) for v in ("Lv ", "x", "", "I")]), (n % 4 + 1).cast("int"))
    s = F.concat(x, F.when(n % 4 == 3, "").otherwise(n.cast("string")), F.lit(" / "), (F.col("l_quantity").cast("int") % 9).cast("string"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.progress(s)["lv"].alias("lv"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 20 THEN p_size END AS lv FROM part")
def str4_title_part(spark, d):
    return t(spark, d, "part").select("p_partkey", text.title_level(F.concat(F.lit("Cap: "), F.col("p_size").cast("string"), F.lit(" "), F.lower("p_brand"))).alias("lv"))


@query("SELECT c_custkey, CASE WHEN length(d) BETWEEN 8 AND 14 THEN d END AS uid FROM (SELECT c_custkey, (c_custkey * 7919)::VARCHAR || '0017' AS d FROM customer)")
def str8_labelled_id(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select("c_custkey", text.labelled_id(F.concat(F.lit("UID: "), (k * 7919).cast("string"), F.lit("OOl7"))).alias("uid"))


@query("SELECT doc_id, CASE WHEN length(d) BETWEEN 1 AND 8 THEN d END AS counter FROM (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM documents)")
def str7_counter_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", text.counter(F.col("text"), F.lit(True)).alias("counter"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place FROM part")
def str9_natural_order(spark, d):
    p = t(spark, d, "part").withColumn("file", F.concat(F.lit("Card_"), F.col("p_size").cast("string"), F.lit(".png")))
    return p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(text.natural_key(F.col("file")), "p_partkey")).alias("place"))


NAMED = ["M416 glacier", "aug a3", "UMP45", "A K M", "SCAR-L", "beryl m762", "VECTOR", "none here", "HONEY BADGER", "AKIVI"]


@query("SELECT p_partkey, ['M416', 'AUG', 'UMP', 'AKM', 'SCAR-L', 'M762', 'VECTOR', NULL, 'HONEY BADGER', 'AKM'][p_partkey % 10 + 1] AS name, CASE p_partkey % 10 WHEN 7 THEN NULL WHEN 9 THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM part")
def str6_names(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in NAMED]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return text.with_names(t(spark, d, "part").select("p_partkey", s.alias("text")), "text").select("p_partkey", "name", "weight")


# -- review ------------------------------------------------------------------------------------

@query("""
SELECT 'review:' || user_id || ':classification' AS id, CASE WHEN decision = 'UNKNOWN' THEN 'P1' ELSE 'P2' END AS priority, CASE WHEN decision = 'UNKNOWN' THEN 'CLASSIFICATION_UNKNOWN' WHEN alternatives > 0 THEN 'CLASSIFICATION_AMBIGUOUS' ELSE 'CLASSIFICATION_LOW_CONFIDENCE' END AS reason,
 (row_number() OVER (PARTITION BY user_id % 16 ORDER BY CASE WHEN decision = 'UNKNOWN' THEN 'P1' ELSE 'P2' END, user_id, 'review:' || user_id || ':classification') - 1)::INTEGER AS order_index FROM (
""" + SQL["dec2_decision_events"] + ") WHERE decision IN ('REVIEW', 'UNKNOWN')")
def st4_review_queue(spark, d):
    dec = dec2_decision_events(spark, d).withColumnRenamed("user_id", "source_id")
    items = review.queue([review.classification_items(dec)]).withColumn("account", F.col("source_id").cast("long") % 16)
    index = dec.select("source_id", F.col("source_id").alias("source_index"))
    return review.ordered(items, index, "account").select("id", "priority", "reason", "order_index")


@query("""
SELECT id, CASE WHEN s = 'RESOLVED_MANUAL' AND a <> 'accept_machine' THEN s WHEN s = 'RESOLVED_MANUAL' AND f = fingerprint THEN s WHEN s IN ('REJECTED', 'SKIPPED') THEN s ELSE 'OPEN' END AS status, coalesce(s = 'RESOLVED_MANUAL' AND a = 'accept_machine' AND f <> fingerprint, false) AS stale
FROM (SELECT o_orderkey AS id, o_custkey % 3 AS fingerprint FROM orders) LEFT JOIN (SELECT o_orderkey AS id, ['OPEN', 'RESOLVED_MANUAL', 'REJECTED', 'SKIPPED'][o_orderkey % 4 + 1] AS s, CASE WHEN o_custkey % 2 = 0 THEN 'accept_machine' ELSE 'set_level' END AS a, o_custkey % 2 AS f FROM orders WHERE o_orderkey % 5 > 0) USING (id)
""")
def st5_reconciled(spark, d):
    o, k, c = t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    old = o.where(k % 5 > 0).select(k.alias("id"), F.element_at(F.array(*[F.lit(x) for x in ("OPEN", "RESOLVED_MANUAL", "REJECTED", "SKIPPED")]), (k % 4 + 1).cast("int")).alias("status"), F.when(c % 2 == 0, "accept_machine").otherwise("set_level").alias("action"), (c % 2).alias("fingerprint"))
    return review.reconciled(o.select(k.alias("id"), (c % 3).alias("fingerprint")), old).select("id", "status", "stale")


@query("""
WITH s AS (SELECT ['OPEN', 'RESOLVED_MANUAL', 'REJECTED', 'SKIPPED'][o_orderkey % 4 + 1] AS s, 'P' || (o_custkey % 4) AS p FROM orders)
SELECT count(*) FILTER (WHERE s = 'OPEN') AS open, count(*) FILTER (WHERE s = 'RESOLVED_MANUAL') AS resolved_manual, count(*) FILTER (WHERE s = 'REJECTED') AS rejected, count(*) FILTER (WHERE s = 'SKIPPED') AS skipped,
 count(*) FILTER (WHERE s = 'OPEN' AND p = 'P0') AS open_p0, count(*) FILTER (WHERE s = 'OPEN' AND p = 'P1') AS open_p1, count(*) FILTER (WHERE s = 'OPEN' AND p = 'P2') AS open_p2, count(*) FILTER (WHERE s = 'OPEN' AND p = 'P3') AS open_p3 FROM s
""")
def agg5_review_summary(spark, d):
    k = F.col("o_orderkey")
    return review.summary(t(spark, d, "orders").select(F.element_at(F.array(*[F.lit(x) for x in ("OPEN", "RESOLVED_MANUAL", "REJECTED", "SKIPPED")]), (k % 4 + 1).cast("int")).alias("status"), F.concat(F.lit("P"), (F.col("o_custkey") % 4).cast("string")).alias("priority")))


# -- layout ------------------------------------------------------------------------------------

PANELS = "SELECT p_partkey AS id, p_brand AS g, 100 + p_size AS w, 80 + (p_partkey % 50)::INTEGER AS h FROM part"


def _panels(spark, d) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), (100 + F.col("p_size")).cast("int").alias("w"), (80 + F.col("p_partkey") % 50).cast("int").alias("h"))


@query(f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM ({PANELS})),
c AS (SELECT *, greatest(1, least(6, n))::BIGINT AS k FROM p), d AS (SELECT *, greatest(1, (900 - 4 * (k - 1)) // k) AS cw FROM c),
e AS (SELECT *, greatest(1, round_even(cw * h / w, 0))::INTEGER AS nh, i // k AS r, i % k AS col FROM d), f AS (SELECT g, r, max(nh) AS rh FROM e GROUP BY 1, 2),
y AS (SELECT g, r, coalesce(sum(rh + 4) OVER (PARTITION BY g ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS py FROM f)
SELECT id, e.r::INTEGER AS "row", col::INTEGER AS "column", (col * (cw + 4))::INTEGER AS px, py, cw::INTEGER AS pw, nh AS ph FROM e JOIN y ON y.g = e.g AND y.r = e.r
""")
def lay1_place_rows(spark, d):
    return layout.place_rows(_panels(spark, d), "g", ["id"], 900, 6, 4).select("id", "row", "column", F.col("px").cast("int").alias("px"), F.col("py").cast("long").alias("py"), "pw", "ph")


@query(f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM ({PANELS})),
c AS (SELECT *, greatest(1, least(3, n))::BIGINT AS k FROM p), d AS (SELECT *, greatest(1, (900 - 4 * (k - 1)) // k) AS cw, ceil(n / k)::BIGINT AS per FROM c),
e AS (SELECT *, greatest(1, round_even(cw * h / w, 0))::INTEGER AS nh, i % per AS r, i // per AS col FROM d),
b AS (SELECT *, least(greatest(240, greatest(1, ceil(nh / 1.35::DOUBLE))), greatest(greatest(1, ceil(nh / 1.35::DOUBLE)), floor(nh * 1.35::DOUBLE)))::INTEGER AS ph FROM e),
f AS (SELECT g, r, greatest(max(ph), 240) AS rh FROM b GROUP BY 1, 2), y AS (SELECT g, r, coalesce(sum(rh + 4) OVER (PARTITION BY g ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS py FROM f)
SELECT id, b.r::INTEGER AS "row", col::INTEGER AS "column", (col * (cw + 4))::INTEGER AS px, py, cw::INTEGER AS pw, ph FROM b JOIN y ON y.g = b.g AND y.r = b.r
""")
def lay2_place_columns(spark, d):
    return layout.place_columns(_panels(spark, d), "g", ["id"], 900, 3, 4, target=240).select("id", "row", "column", F.col("px").cast("int").alias("px"), F.col("py").cast("long").alias("py"), "pw", "ph")


@query(f"""
WITH p AS (SELECT g, greatest(1, round_even(greatest(1, (900 - 4 * (least(6, n) - 1)) // least(6, n)) * h / w, 0)) AS nh FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ({PANELS})))
SELECT g, greatest(1, round_even(median(nh), 0))::INTEGER AS row_h FROM p GROUP BY 1
""")
def lay3_uniform_height(spark, d):
    return layout.uniform_height(_panels(spark, d), "g", 900, 6, 4)


@query("""
WITH n AS (SELECT o_custkey AS k, count(*) * 3 AS n FROM orders GROUP BY 1),
o AS (SELECT k, n, unnest(range(2, greatest(2, ceil(n / 8)::BIGINT) + 2)) AS c FROM n),
s AS (SELECT *, CASE WHEN ceil(n / c) BETWEEN 8 AND 15 THEN 0 ELSE abs(ceil(n / c) - 11) * 100 END + (c * ceil(n / c) - n) * 20 + abs(ceil(n / c) - 11) AS cost FROM o),
b AS (SELECT k, n, arg_min(c, cost * 1000 + c) AS c FROM s GROUP BY 1, 2)
SELECT k, CASE WHEN n <= 15 THEN 1 ELSE c END::INTEGER AS columns, CASE WHEN n <= 15 THEN n ELSE ceil(n / c) END::INTEGER AS rows FROM b
""")
def lay4_columns_and_rows(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.count(F.lit(1)) * 3).alias("n"))
    return n.select("k", layout.columns_and_rows(F.col("n")).alias("x")).select("k", F.col("x.columns").alias("columns"), F.col("x.rows").alias("rows"))


@query("""
WITH z AS (SELECT n_regionkey AS g, n_nationkey AS o, (1 + n_nationkey % 4)::DOUBLE AS ratio, n_nationkey % 3 AS items FROM nation), l AS (SELECT * FROM z WHERE items > 0),
e AS (SELECT *, ratio / sum(ratio) OVER (PARTITION BY g) AS share, sum(ratio) OVER (PARTITION BY g ORDER BY o) / sum(ratio) OVER (PARTITION BY g) AS cum, lead(o) OVER (PARTITION BY g ORDER BY o) IS NULL AS last FROM l),
s AS (SELECT *, CASE WHEN last THEN 1000 ELSE round_even(cum * 1000, 0) END::INTEGER AS stop FROM e)
SELECT g, o, share, coalesce(lag(stop) OVER (PARTITION BY g ORDER BY o), 0) AS start, stop FROM s
""")
def lay6_zones(spark, d):
    k = F.col("n_nationkey")
    z = t(spark, d, "nation").select(F.col("n_regionkey").alias("g"), k.alias("o"), (1 + k % 4).cast("double").alias("ratio"), (k % 3).alias("items"))
    return layout.zones(z, "g", "o", "ratio", "items", 1000)


@query(f"WITH p AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS i FROM ({PANELS})), m AS (SELECT g, unnest(range(0, (max(i) // 7 + 1) * 7)) AS i FROM p GROUP BY g) SELECT m.g, (m.i // 7)::INTEGER AS \"column\", (m.i % 7)::INTEGER AS \"row\", p.id FROM m LEFT JOIN p ON p.g = m.g AND p.i = m.i")
def lay11_padded_grid(spark, d):
    return layout.padded_grid(_panels(spark, d).select("g", "id"), "g", ["id"], 7).select("g", "column", "row", "id")


@query("SELECT o_custkey AS k, CASE WHEN count(*) < 10 THEN 1 WHEN count(*) <= 24 THEN 2 ELSE 3 END AS columns FROM orders GROUP BY 1")
def lay15_auto_columns(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("k", layout.auto_columns(F.col("n")).alias("columns"))


@query()
def lay13_two_per_row(spark, d):
    p = _panels(spark, d).withColumn("small", F.col("w") < 120)
    return layout.two_per_row(p, "g", ["id"], "small", "h", 1000)


# -- sources -----------------------------------------------------------------------------------

@query("""
WITH f AS (SELECT c_custkey AS k, ['gun', 'TP', 'vehicle', 'zzz'][c_custkey % 4 + 1] || '_' || c_custkey || '.png' AS f FROM customer)
SELECT k, lower(split_part(f, '_', 1)) AS category FROM f WHERE lower(split_part(f, '_', 1)) IN ('gun', 'tp', 'vehicle')
""")
def src6_categorised_files(spark, d):
    k = F.col("c_custkey")
    f = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("gun", "TP", "vehicle", "zzz")]), (k % 4 + 1).cast("int")), F.lit("_"), k.cast("string"), F.lit(".png"))
    return catalog.categorised(t(spark, d, "customer").select(k.alias("k"), f.alias("filename")), ["gun", "tp", "vehicle"]).select("k", "category")


@query("SELECT s_nationkey AS code, min(s_suppkey) AS first_id FROM supplier GROUP BY 1")
def src8_first_folder(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("code"), "s_suppkey")
    return catalog.first_per_code(s, F.col("code"), "s_suppkey").select("code", F.col("s_suppkey").alias("first_id"))


@query("""
WITH f AS (SELECT o_custkey AS k, CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN o_orderkey // 4 % 2 ELSE 0 END AS place, 90 + o_orderkey % 21 AS w, 40 + o_orderkey % 11 AS h FROM orders),
 g AS (SELECT k, place, count(*) AS n, list_sort(list(w))[count(*) // 2 + 1] AS mw, list_sort(list(h))[count(*) // 2 + 1] AS mh FROM f GROUP BY k, place),
 c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) AS r FROM g WHERE k % 5 > 0 OR place = 1)
SELECT CASE place WHEN 0 THEN 'C' ELSE 'c' END || k AS code, place::INTEGER AS place, n AS "count", greatest(1, round_even(100 * (2 + k % 4) / mw::DOUBLE, 0))::INTEGER AS columns, greatest(1, round_even(45 * (1 + k % 5) / mh::DOUBLE, 0))::INTEGER AS "rows"
FROM c WHERE r = 1
""")
def src8_catalogue(spark, d):
    """Accounts below two roots: an order is a single picture, a customer a folder, whose reference every fifth lacks below the first root."""
    from quiltframe.sources import folders

    k, o = F.col("o_custkey"), F.col("o_orderkey")
    place = F.when(k % 3 == 0, 1).when(k % 3 == 1, F.floor(o / 4) % 2).otherwise(0)
    root = lambda p, key: F.concat(F.when(p == 0, "/first/C").otherwise("/second/c"), key.cast("string"))
    parts = t(spark, d, "orders").select(F.concat(root(place, k), F.lit("/anhle/gun_"), o.cast("string"), F.lit(".png")).alias("path"), (90 + o % 21).cast("int").alias("width"), (40 + o % 11).cast("int").alias("height"))
    c = F.col("c_custkey")
    both = t(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("p"))
    name = F.when((F.col("p") == 0) & (c % 5 == 0), "xem_truoc.png").when(c % 2 == 0, F.concat(F.lit("C"), c.cast("string"), F.lit(".PNG"))).otherwise("whole.png")
    whole = both.select(F.concat(root(F.col("p"), c), F.lit("/"), name).alias("path"), (100 * (2 + c % 4)).cast("int").alias("width"), (45 * (1 + c % 5)).cast("int").alias("height"))
    return folders.catalogue(parts.unionByName(whole), ["/first", "/second"]).select("code", "place", "count", "columns", "rows")


@query("SELECT p_partkey, sha256(concat_ws(':', p_brand, p_type, p_partkey::VARCHAR, p_size::VARCHAR))[1:16] AS id FROM part")
def key_asset_ids(spark, d):
    return t(spark, d, "part").select("p_partkey", keys.digest(F.col("p_brand"), F.col("p_type"), F.col("p_partkey"), F.col("p_size"), length=16).alias("id"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def set2_union(spark, d):
    return t(spark, d, "nation").select(F.col("n_name").alias("name")).union(t(spark, d, "region").select("r_name")).distinct()


@query("SELECT p_partkey, b - a AS step FROM (SELECT p_partkey, p_retailprice AS b, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS a FROM part)")
def win6_steps(spark, d):
    return ordering.steps(t(spark, d, "part"), "p_brand", ["p_retailprice", "p_partkey"], "p_retailprice").select("p_partkey", "step")


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT k, i, v AS last, v, true AS kept FROM o WHERE i = 1 UNION ALL
 SELECT r.k, o.i, CASE WHEN o.v - r.last >= 1000 THEN o.v ELSE r.last END, o.v, o.v - r.last >= 1000 FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1)
SELECT k, v FROM r WHERE kept
""")
def win5_spaced(spark, d):
    from quiltframe.operators.ordering import spaced

    return spaced(t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), "k", "v", 1000)


# -- more decisions, state and layout ------------------------------------------------------------

CARDS = "SELECT l_orderkey AS s, l_linenumber AS id, min((l_partkey % 1000)::INTEGER) AS x, min((150 + l_quantity * 2)::INTEGER) AS w, min((60 + l_suppkey % 80)::INTEGER) AS h, min(l_discount * 6) AS fill FROM lineitem GROUP BY 1, 2"


def _cards(spark, d) -> DataFrame:
    c = F.col
    rows = t(spark, d, "lineitem").groupBy(c("l_orderkey").alias("s"), c("l_linenumber").alias("id"))
    return rows.agg(F.min((c("l_partkey") % 1000).cast("int")).alias("x"), F.min((150 + c("l_quantity") * 2).cast("int")).alias("w"), F.min((60 + c("l_suppkey") % 80).cast("int")).alias("h"), F.min(c("l_discount") * 6).alias("fill"))


@query(f"""
WITH b AS (SELECT *, w * h AS a, w::DOUBLE / h AS r FROM ({CARDS})), o AS (SELECT *, a * greatest(0.5::DOUBLE, 1 - abs(r - 2) * 0.4::DOUBLE) AS score FROM b WHERE a >= 15000 AND r BETWEEN 1.5::DOUBLE AND 2.5::DOUBLE AND fill <= 0.5::DOUBLE)
SELECT s, id, score FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, id) AS k FROM o) WHERE k = 1
""")
def flt6_best_card(spark, d):
    return decide.best_card(_cards(spark, d), "s", 15000)


@query(f"""
WITH b AS (SELECT *, w * h AS a, w::DOUBLE / h AS r FROM ({CARDS}))
SELECT s, id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN r BETWEEN 1.75::DOUBLE AND 2.25::DOUBLE THEN 0 ELSE 1 END, CASE WHEN x >= 250 THEN 0 ELSE 1 END, abs(r - 2), -a, id) AS k FROM b WHERE a >= 12000 AND r BETWEEN 1.6::DOUBLE AND 2.4::DOUBLE) WHERE k = 1
""")
def flt7_selected_item(spark, d):
    return decide.selected_item(_cards(spark, d), "s", 1000, 12000).select("s", "id")


@query(f"SELECT s, id FROM ({CARDS}) WHERE w BETWEEN 1000 * 0.17::DOUBLE AND 1000 * 0.24::DOUBLE AND h BETWEEN 500 * 0.15::DOUBLE AND 500 * 0.25::DOUBLE AND w::DOUBLE / h BETWEEN 1.5::DOUBLE AND 2.6::DOUBLE AND (w * h * (1 - fill)) / (w * h) >= 0.6::DOUBLE")
def flt5_profile(spark, d):
    c = F.col
    p = {"w_min": 0.17, "w_max": 0.24, "h_min": 0.15, "h_max": 0.25, "aspect_min": 1.5, "aspect_max": 2.6}
    return _cards(spark, d).where(decide.fits_profile(c("w"), c("h"), c("w") * c("h") * (1 - c("fill")), 1000, 500, p)).select("s", "id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08::DOUBLE THEN 'strong' WHEN l_tax > 0.06::DOUBLE THEN 'medium' WHEN l_returnflag = 'R' THEN 'weak' END AS signal, CASE WHEN l_discount > 0.08::DOUBLE THEN 0.96::DOUBLE WHEN l_tax > 0.06::DOUBLE THEN 0.92::DOUBLE WHEN l_returnflag = 'R' THEN 0.88::DOUBLE END AS confidence FROM lineitem")
def dec14_first_signal(spark, d):
    c = F.col
    s = decide.first_signal([("strong", c("l_discount") > 0.08, 0.96), ("medium", c("l_tax") > 0.06, 0.92), ("weak", c("l_returnflag") == "R", 0.88)])
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 7) / 7.0::DOUBLE END AS a, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 11) / 11.0::DOUBLE END AS b, CASE WHEN o_orderkey % 2 > 0 THEN (o_orderkey % 13) / 13.0::DOUBLE END AS c FROM orders),
m AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 0.0::DOUBLE ELSE (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / ((a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER) END AS confidence FROM f)
SELECT o_orderkey, confidence, a IS NULL OR b IS NULL OR confidence < 0.8::DOUBLE OR o_orderkey % 17 = 0 AS review FROM m
""")
def dec10_ocr_confidence(spark, d):
    k = F.col("o_orderkey")
    a, b, c = F.when(k % 3 > 0, (k % 7) / 7), F.when(k % 5 > 0, (k % 11) / 11), F.when(k % 2 > 0, (k % 13) / 13)
    return t(spark, d, "orders").select("o_orderkey", decide.ocr_confidence(a, a, b, b, c, k % 17 == 0).alias("x")).select("o_orderkey", "x.*")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'manual' END, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' END, o_orderstatus) AS category FROM orders")
def dec3_chosen_category(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", decide.chosen_category(F.when(k % 5 == 0, "manual"), F.when(k % 3 == 0, "kept"), F.col("o_orderstatus")).alias("category"))


@query("SELECT c_custkey, coalesce(n, 'generic') AS detector FROM customer LEFT JOIN (SELECT n_nationkey, n_name AS n FROM nation WHERE n_nationkey % 3 > 0) ON n_nationkey = c_nationkey")
def dec5_dispatched(spark, d):
    dim = t(spark, d, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("category"), F.col("n_name").alias("detector"))
    return decide.dispatched(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("category")), dim, "generic").select("c_custkey", "detector")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN 'ERROR' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 <> 1 THEN 'made by version ' || (o_orderkey % 4) END AS error FROM orders")
def flt3_version_gate(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("string").alias("version"), F.col("o_orderstatus").alias("status"))
    return decide.version_gate(rows, "1").select("o_orderkey", "status", "error")


@query("WITH h AS (SELECT user_id, min(event_id) AS hit FROM events WHERE value >= 90 GROUP BY 1) SELECT e.user_id, event_id FROM events e LEFT JOIN h ON h.user_id = e.user_id WHERE hit IS NULL OR event_id <= hit")
def st13_until_sure(spark, d):
    return decide.until_sure(t(spark, d, "events"), "user_id", "event_id", "value", 90).select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN (SELECT o_orderkey, true AS s FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey WHERE NOT coalesce(s AND l_returnflag IN ('R', 'A') AND l_linestatus <> 'O', false)")
def st2_without_stale(spark, d):
    c = F.col
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_orderkey").alias("source_id"), c("l_returnflag").alias("detector"), (c("l_linestatus") == "O").alias("manual_override"))
    return overrides.without_stale_assets(rows, t(spark, d, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("source_id")), ["R", "A"]).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id AS owner FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def jn2_orphans_pruned(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return overrides.orphans_pruned(t(spark, d, "labels").select(F.col("doc_id").alias("owner")), docs.where("id % 2 = 0"), docs.where("id % 3 = 0"))


@query("SELECT o_orderkey AS asset_id, CASE WHEN o_orderstatus = 'O' AND c_custkey IS NULL THEN 'STALE' WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'SKIPPED' END AS status FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_orderkey")
def st11_stale_items(spark, d):
    items = t(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("SKIPPED").alias("status"))
    return overrides.stale_items(items, t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 AND NOT value::INTEGER BETWEEN 1 AND 20 THEN 'level must be 1 to 20' WHEN event_id % 4 = 3 THEN 'unknown action' END AS error FROM events")
def st7_checked_actions(spark, d):
    k = F.col("event_id") % 4
    a = F.when(k == 0, "set_level").when(k == 1, "set_name").when(k == 2, "reject").otherwise("fly")
    v = F.bround("value").cast("int").cast("string")
    rows = t(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("target"), a.alias("action"), v.alias("value"))
    return overrides.checked_actions(rows).select("event_id", "error")


@query("""
WITH i AS (SELECT p_partkey AS id, p_brand AS g, 100 + p_size AS w, 50 + (p_partkey % 40)::INTEGER AS h FROM part),
n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS i FROM i),
e AS (SELECT *, round_even(24000.0::DOUBLE * i / n, 0)::INTEGER AS px, round_even(24000.0::DOUBLE * (i + 1) / n, 0)::INTEGER AS nx FROM n)
SELECT id, px, nx - px AS pw, max(round_even((nx - px)::DOUBLE * h / w, 0)::INTEGER) OVER (PARTITION BY g) AS ph FROM e
""")
def lay7_header_slots(spark, d):
    return _header_slots(t(spark, d, "part"), 24000)


def _header_slots(part, width):
    c = F.col
    items = part.select(c("p_partkey").alias("id"), c("p_brand").alias("g"), (100 + c("p_size")).alias("w"), (50 + c("p_partkey") % 40).cast("int").alias("h"))
    return layout.header_slots(items, "g", "id", width).select("id", "px", "pw", "ph")


@query("SELECT k, CASE n WHEN 12 THEN 3 WHEN 15 THEN 3 WHEN 20 THEN 4 WHEN 36 THEN 6 ELSE ceil(n / 5) END::INTEGER AS rows, CASE n WHEN 12 THEN 4 WHEN 15 THEN 5 WHEN 20 THEN 5 WHEN 36 THEN 6 ELSE 5 END::INTEGER AS columns FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)")
def lay16_preset_grid(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("k", layout.preset_grid(F.col("n"), 5).alias("x")).select("k", "x.*")


@query("SELECT l_orderkey, l_linenumber, greatest(0, least((l_partkey % 500)::INTEGER, 400 - (20 + l_quantity)::INTEGER)) AS x, greatest(0, least((l_suppkey % 300)::INTEGER, 250 - 30)) AS y FROM lineitem")
def lay14_kept_on_canvas(spark, d):
    c = F.col
    p = layout.kept_on_canvas((c("l_partkey") % 500).cast("int"), (c("l_suppkey") % 300).cast("int"), (20 + c("l_quantity")).cast("int"), F.lit(30), 400, 250)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("""
WITH i AS (SELECT p_brand AS a, CASE WHEN p_partkey % 3 = 1 AND p_brand LIKE '%1' THEN 'right' ELSE ['left', 'mid', 'right'][p_partkey % 3 + 1] END AS z, p_partkey AS id, 100 + p_size AS w, 80 + (p_partkey % 50)::INTEGER AS h FROM part),
f AS (SELECT DISTINCT a, z, CASE z WHEN 'left' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS place, CASE z WHEN 'left' THEN 1.0::DOUBLE WHEN 'mid' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS ratio, CASE z WHEN 'left' THEN 1 WHEN 'mid' THEN 4 ELSE 6 END AS cols FROM i),
e AS (SELECT *, CASE WHEN lead(place) OVER r IS NULL THEN 3000 ELSE round_even(sum(ratio) OVER (PARTITION BY a ORDER BY place ROWS UNBOUNDED PRECEDING) / sum(ratio) OVER (PARTITION BY a) * 3000, 0) END::INTEGER AS stop FROM f WINDOW r AS (PARTITION BY a ORDER BY place)),
s AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY a ORDER BY place), 0) AS start FROM e),
x AS (SELECT i.*, start, stop - start AS zw, count(*) OVER (PARTITION BY i.a, i.z) AS n, row_number() OVER (PARTITION BY i.a, i.z ORDER BY id) - 1 AS k, cols FROM i JOIN s ON s.a = i.a AND s.z = i.z),
y AS (SELECT *, least(cols, n) AS c, greatest(1, (zw - 4 * (least(cols, n) - 1)) // least(cols, n)) AS pw FROM x),
v AS (SELECT *, greatest(1, round_even(pw::DOUBLE * h / w, 0))::INTEGER AS ph, k // c AS r FROM y),
hh AS (SELECT a, z, r, max(ph) AS rh FROM v GROUP BY 1, 2, 3), yy AS (SELECT a, z, r, coalesce(sum(rh + 4) OVER (PARTITION BY a, z ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS py FROM hh)
SELECT v.a AS account, v.z AS zone, id, (start + (k % c) * (pw + 4))::INTEGER AS px, py, pw::INTEGER AS pw, ph FROM v JOIN yy ON yy.a = v.a AND yy.z = v.z AND yy.r = v.r
""")
def lay10_plan(spark, d):
    """Brands ending in 1 have an empty zone, since what would be in it is in the next one."""
    return _plan(t(spark, d, "part"), F.when((F.col("p_partkey") % 3 == 1) & F.col("p_brand").like("%1"), "right").otherwise(_zone()))


def _zone():
    return F.element_at(F.array(*[F.lit(z) for z in ("left", "mid", "right")]), (F.col("p_partkey") % 3 + 1).cast("int"))


def _plan(part, zone):
    c = F.col
    items = part.select(c("p_brand").alias("account"), zone.alias("zone"), c("p_partkey").alias("id"), (100 + c("p_size")).alias("w"), (80 + c("p_partkey") % 50).cast("int").alias("h"))
    zones = F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(i).alias("place"), F.lit(r).alias("ratio"), F.lit(n).alias("columns")) for z, i, r, n in (("left", 0, 1.0, 1), ("mid", 1, 2.0, 4), ("right", 2, 3.0, 6))])
    forms = items.select("account").distinct().select("account", F.inline(zones)).withColumn("width", F.lit(3000))
    return layout.plan(items, forms, 4)


@query("""
WITH s AS (SELECT user_id, event_id, sum(value) OVER w AS s, count(*) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS n FROM s WHERE k = 3) WHERE n = 1
""")
def win9_best_window(spark, d):
    from quiltframe.operators.boxes import best_window

    return best_window(t(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 3).select("user_id", "event_id")


@query("WITH m AS (SELECT p_brand, median(p_size) AS m FROM part GROUP BY 1) SELECT p_partkey FROM part JOIN m USING (p_brand) WHERE abs(p_size - m) <= 5")
def win11_near_median(spark, d):
    from quiltframe.operators.boxes import near_median

    return near_median(t(spark, d, "part"), "p_brand", "p_size", 5).select("p_partkey")


def _tiles(spark, d) -> DataFrame:
    """The lines of an order as tiles of a grid of three columns, some off their places."""
    c = F.col
    n, off = c("l_linenumber") - 1, F.when(c("l_partkey") % 11 == 0, 37).otherwise(c("l_partkey") % 5)
    tiles = t(spark, d, "lineitem").select(
        c("l_orderkey").alias("source"), c("l_linenumber").alias("id"), ((n % 3) * 110 + off).cast("long").alias("x"), (F.floor(n / 3) * 112 + c("l_suppkey") % 4).cast("long").alias("y"),
        (100 + c("l_quantity") % 4).cast("long").alias("w"), (100 + c("l_quantity") % 3).cast("long").alias("h"),
    )
    return tiles.groupBy("source", "id").agg(*[F.min(k).alias(k) for k in "xywh"])


@query()
def win7_grid_lineitem(spark, d):
    from quiltframe.operators.boxes import grid_of

    return grid_of(_tiles(spark, d), "source", screen=(320, 320))


@query()
def win8_misc_tiles(spark, d):
    from quiltframe.operators.boxes import MISC, grid_of, whole_tiles

    tiles = _tiles(spark, d)
    return whole_tiles(grid_of(tiles, "source", MISC, (320, 320), placed=True), "source")


@query("""
WITH g AS (SELECT l_orderkey AS source, (l_linenumber - 1) // 3 AS r, (l_linenumber - 1) % 3 AS c, min((l_linenumber - 1) % 3 * 110 + l_partkey % 9)::DOUBLE AS x, min((l_linenumber - 1) // 3 * 112 + l_suppkey % 8)::DOUBLE AS y,
  min(100 + l_quantity % 7)::DOUBLE AS w, min(100 + l_quantity % 5)::DOUBLE AS h FROM lineitem GROUP BY 1, 2, 3),
z AS (SELECT source, count(*) AS n, round((greatest(0, 1 - 2 * stddev_pop(w) / greatest(1, median(w))) + greatest(0, 1 - 2 * stddev_pop(h) / greatest(1, median(h)))) / 2 + 1e-9, 4) AS size, median(w) AS mw, median(h) AS mh,
  round(least(1, count(*) / ((max(r) + 1) * (max(c) + 1))) + 1e-9, 4) AS fill, any_value(w) AS w1, any_value(h) AS h1, any_value(x) AS x1, any_value(y) AS y1 FROM g GROUP BY 1),
ra AS (SELECT source, round(avg(greatest(0, 1 - sd / greatest(1, mh * 0.15::DOUBLE))) + 1e-9, 4) AS s FROM (SELECT source, r, stddev_pop(y + h / 2) AS sd FROM g GROUP BY 1, 2 HAVING count(*) >= 2) JOIN z USING (source) GROUP BY 1),
ca AS (SELECT source, round(avg(greatest(0, 1 - sd / greatest(1, mw * 0.15::DOUBLE))) + 1e-9, 4) AS s FROM (SELECT source, c, stddev_pop(x + w / 2) AS sd FROM g GROUP BY 1, 2 HAVING count(*) >= 2) JOIN z USING (source) GROUP BY 1),
st AS (SELECT source, x + w / 2 - lag(x + w / 2) OVER (PARTITION BY source, r ORDER BY x) AS hs, y + h / 2 - lag(y + h / 2) OVER (PARTITION BY source, c ORDER BY y) AS vs FROM g),
sp AS (SELECT source, CASE WHEN count(hs) >= 2 THEN greatest(0, 1 - 3 * stddev_pop(hs) / greatest(1, median(hs))) END AS a, CASE WHEN count(vs) >= 2 THEN greatest(0, 1 - 3 * stddev_pop(vs) / greatest(1, median(vs))) END AS b FROM st GROUP BY 1),
p AS (SELECT z.*, coalesce(ra.s, 1) AS rs, coalesce(ca.s, 1) AS cs, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b, 1) END + 1e-9, 4) AS spacing FROM z LEFT JOIN ra USING (source) LEFT JOIN ca USING (source) LEFT JOIN sp USING (source)),
o AS (SELECT *, w1 * h1 / 102400 AS share, abs(w1 / h1 - 1) AS dev, least(x1, y1, greatest(0, 320 - x1 - w1), greatest(0, 320 - y1 - h1)) AS margin FROM p)
SELECT source, n, CASE WHEN n = 1 THEN round(0.4::DOUBLE * CASE WHEN share < 0.18::DOUBLE THEN share / 0.18::DOUBLE WHEN share <= 0.65::DOUBLE THEN 1 ELSE greatest(0, 1 - (share - 0.65::DOUBLE) / 0.35::DOUBLE) END
   + 0.35::DOUBLE * CASE WHEN dev <= 0.1::DOUBLE THEN 1 ELSE greatest(0, 1 - (dev - 0.1::DOUBLE) * 2) END + 0.25::DOUBLE * CASE WHEN margin >= 20 THEN 1 ELSE greatest(0, margin / 20) END + 1e-9, 4)
  ELSE round(0.25::DOUBLE * size + 0.2::DOUBLE * rs + 0.2::DOUBLE * cs + 0.25::DOUBLE * spacing + 0.1::DOUBLE * fill + 1e-9, 4) END AS confidence,
 CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE size END AS size, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE rs END AS rows, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE cs END AS columns, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE spacing END AS spacing, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE fill END AS fill FROM o
""")
def dec8_grid_confidence(spark, d):
    from quiltframe.operators.boxes import grid_confidence

    c = F.col
    n = c("l_linenumber") - 1
    cells = t(spark, d, "lineitem").select(c("l_orderkey").alias("source"), F.floor(n / 3).alias("row"), (n % 3).alias("column"), ((n % 3) * 110 + c("l_partkey") % 9).alias("x"), (F.floor(n / 3) * 112 + c("l_suppkey") % 8).alias("y"), (100 + c("l_quantity") % 7).alias("w"), (100 + c("l_quantity") % 5).alias("h"))
    cells = cells.groupBy("source", "row", "column").agg(*[F.min(k).cast("double").alias(k) for k in "xywh"])
    return grid_confidence(cells, "source", F.lit(320), F.lit(320))


@query()
def jn12_joined_boxes(spark, d):
    from quiltframe.operators.boxes import joined_boxes

    return joined_boxes(_boxes(spark, d).select("source", *[F.col("rect")[c].cast("double").alias(c) for c in "xywh"]), "source", 10)


@query("""
WITH r AS (SELECT l_orderkey AS s, l_linenumber AS id, min(l_partkey % 60) AS x0, min(l_partkey % 60 + 100 + l_quantity) AS x1, min(l_suppkey * 7 % 200) AS y FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.s, a.id AS high, b.id AS low, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS len FROM r a JOIN r b ON a.s = b.s AND b.y - a.y BETWEEN 20 AND 120 AND abs(a.x0 - b.x0) <= 30 AND abs(a.x1 - b.x1) <= 30)
SELECT s, high, low FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY len DESC, high, low) AS k FROM p) WHERE k = 1
""")
def jn13_edge_pairs(spark, d):
    from quiltframe.operators.boxes import edge_pairs

    c = F.col
    x0 = c("l_partkey") % 60
    r = t(spark, d, "lineitem").groupBy(c("l_orderkey").alias("s"), c("l_linenumber").alias("id")).agg(F.min(x0).alias("x0"), F.min(x0 + 100 + c("l_quantity")).alias("x1"), F.min(c("l_suppkey") * 7 % 200).alias("y"))
    return edge_pairs(r, "s", (20, 120), 30)


@query("SELECT p_partkey, CASE WHEN c LIKE 'star_%' THEN 0 WHEN c = 'vip' THEN 1 ELSE 2 END AS rank, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN c LIKE 'star_%' THEN 0 WHEN c = 'vip' THEN 1 ELSE 2 END, CASE WHEN c LIKE 'star_%' THEN -p_size ELSE 0 END, p_partkey) - 1 AS place FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'star_' || p_size WHEN 1 THEN 'vip' ELSE 'normal' END AS c FROM part)")
def srt6_outfit_order(spark, d):
    from quiltframe.operators.ordering import outfit_order

    k = F.col("p_partkey") % 3
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.when(k == 0, F.concat(F.lit("star_"), F.col("p_size").cast("string"))).when(k == 1, "vip").otherwise("normal").alias("choice"), F.col("p_partkey").alias("i"))
    return p.select("p_partkey", outfit_order()[0].alias("rank"), (F.row_number().over(Window.partitionBy("p_brand").orderBy(*outfit_order())) - 1).alias("place"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN c_custkey % 40 WHEN c_custkey % 9 BETWEEN 1 AND 8 THEN c_custkey % 9 END AS lv FROM customer")
def str11_legacy_level(spark, d):
    k = F.col("c_custkey")
    s = F.when(k % 3 == 0, "I / 7").when(k % 3 == 1, F.concat((k % 40).cast("string"), F.lit(" / 50"))).otherwise(F.concat(F.lit("Lv. "), (k % 9).cast("string")))
    return t(spark, d, "customer").select("c_custkey", text.legacy_level(s).cast("long").alias("lv"))


FAMILY = ["M4I6", "AVG", "UMP45", "AK47", "KAR9B", "zz99", "MP5K", "DP2B"]


@query("SELECT c_custkey, [0, 1, 2, 3, 4, 5, 2, 4][c_custkey % 8 + 1] AS rank, ['M416', 'AUG', 'UMP', 'AKM', 'KAR98', 'ZZ', 'UMP', 'DP28'][c_custkey % 8 + 1] AS family FROM customer")
def str10_family(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in FAMILY]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return t(spark, d, "customer").select("c_custkey", text.family(s).alias("f")).select("c_custkey", "f.*")


@query("SELECT n_nationkey, [1, 4, NULL, 10, 20][n_nationkey % 5 + 1] AS lv FROM nation")
def str3_roman(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in ("I", "iv", "IIII", "X", "XX")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return t(spark, d, "nation").select("n_nationkey", text.roman(s).alias("lv"))


@query("SELECT doc_id, strip_accents(text) = text AS same FROM documents WHERE lang IN ('en', 'fr', 'es', 'de')")
def str1_plain_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", (text.plain(F.col("text")) == F.col("text")).alias("same"))


@query("SELECT event_id, regexp_matches(event_type, '^[a-zA-Z0-9_-]+$') AS ok FROM events")
def str17_account_ids(spark, d):
    return t(spark, d, "events").select("event_id", text.is_account_id(F.col("event_type")).alias("ok"))


@query("SELECT user_id, count(*) AS recent FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def dt1_recent_events(spark, d):
    e = t(spark, d, "events")
    last = e.agg(F.max("ts")).first()[0]
    return e.where(dates.recent(F.col("ts").cast("timestamp_ntz"), F.lit(str(last)).cast("timestamp_ntz"), 7)).groupBy("user_id").agg(F.count(F.lit(1)).alias("recent"))


@query("SELECT n_name FROM nation ANTI JOIN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') ON r_regionkey = n_regionkey")
def set3_difference(spark, d):
    out = t(spark, d, "region").where(F.col("r_name").startswith("A")).select(F.col("r_regionkey").alias("n_regionkey"))
    return t(spark, d, "nation").join(out, "n_regionkey", "left_anti").select("n_name")


@query("SELECT o.o_orderkey, c.c_name, l.n FROM orders o LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def jn1_sources_joined(spark, d):
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    people = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return overrides.with_facts(t(spark, d, "orders"), (people, "o_custkey"), (lines, "o_orderkey")).select("o_orderkey", "c_name", "n")


# -- the rest ------------------------------------------------------------------------------------

@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal < 0) AS debtors, count(*) FILTER (WHERE c_nationkey = 1) AS nation_1 FROM customer")
def agg4_account_info(spark, d):
    return tallies.counts(t(spark, d, "customer"), [], debtors=F.col("c_acctbal") < 0, nation_1=F.col("c_nationkey") == 1)


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY 1")
def agg6_source_counts(spark, d):
    return tallies.counts(t(spark, d, "orders"), ["o_custkey"], done=F.col("o_orderstatus") == "F", large=F.col("o_totalprice") > 100000)


@query("SELECT l_orderkey, avg(l_discount) AS mean, max(l_discount) AS high, min(l_discount) AS low FROM lineitem GROUP BY 1")
def agg12_confidences(spark, d):
    return tallies.confidences(t(spark, d, "lineitem"), "l_orderkey", "l_discount")


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS kinds FROM orders GROUP BY 1")
def agg15_distinct_values(spark, d):
    return tallies.distinct_joined(t(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1 + 1000)::INTEGER AS source_index FROM documents")
def win2_source_index(spark, d):
    return catalog.indexed(t(spark, d, "documents").select("doc_id"), 1000, "doc_id")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' OR l_discount > 0.08::DOUBLE THEN 1 ELSE 0 END, CASE WHEN l_partkey % 4 = 0 THEN 99999 ELSE l_partkey END, l_suppkey, l_quantity, l_linenumber, l_partkey) AS place FROM lineitem")
def srt1_dedup_order(spark, d):
    c = F.col
    rows = t(spark, d, "lineitem").withColumns({"locked": c("l_returnflag") == "R", "empty": F.lit(False), "partial": c("l_discount") > 0.08, "source_index": F.when(c("l_partkey") % 4 != 0, c("l_partkey")), "row": c("l_suppkey"), "column": c("l_quantity"), "id": c("l_linenumber")})
    w = Window.partitionBy("l_orderkey").orderBy(*ordering.dedup_order(), "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY -p_size, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 5 ELSE 5 END, p_partkey) AS place FROM part")
def srt4_simple_order(spark, d):
    w = F.element_at(F.array(*[F.lit(x) for x in ("M416", "AUG", "UMP", "AKM", "X")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").alias("lv"), w.alias("weapon"), F.col("p_partkey").alias("i"))
    return p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*ordering.simple_gun_order())).alias("place"))


@query("""
WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
c AS (SELECT *, i % 3 = 0 AS p, row_number() OVER (PARTITION BY p_brand, i % 3 = 0 ORDER BY i) AS k, row_number() OVER (PARTITION BY p_brand, i % 3 = 0 ORDER BY -i) AS wish FROM p)
SELECT a.p_partkey, CASE WHEN a.p THEN b.i ELSE a.i END AS place FROM c a LEFT JOIN c b ON b.p_brand = a.p_brand AND b.p AND a.p AND b.k = a.wish
""")
def srt8_moved(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("i"))
    return ordering.moved(p.withColumn("wish", F.when(F.col("i") % 3 == 0, -F.col("i"))), "p_brand", "i", "wish").select("p_partkey", F.col("place").cast("long").alias("place"))


@query("""
WITH s AS (SELECT s_nationkey, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name DESC) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_nationkey, arg_min(s_name, s_acctbal) AS profile, arg_max(s_name, s_acctbal) AS lobby FROM s WHERE k <= 2 AND n >= 2 GROUP BY 1
""")
def top3_profile_and_lobby(spark, d):
    s = t(spark, d, "supplier").select("s_nationkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("brightness"))
    return ordering.profile_and_lobby(s, "s_nationkey")


@query("SELECT k, x FROM (SELECT n_nationkey::DOUBLE AS k, n_name AS x FROM nation UNION ALL SELECT 7.5::DOUBLE, 'new')")
def set4_inserted(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"))
    return ordering.inserted(n, spark.createDataFrame([("new",)], "x string"), "k", F.lit(7)).select("k", "x")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND NOT (l_linestatus = 'F' OR l_discount > 0.08::DOUBLE OR l_tax > 0.07::DOUBLE)")
def flt4_ocr_targets(spark, d):
    c = F.col
    cat = F.when(c("l_returnflag") == "N", "GUN").otherwise("OTHER")
    return t(spark, d, "lineitem").where(decide.is_ocr_target(cat, c("l_linestatus") == "F", c("l_discount") > 0.08, c("l_tax") > 0.07, F.lit(False))).select("l_orderkey", "l_linenumber")


@query("WITH m AS (SELECT user_id, event_id % 7 AS phase, avg(value) AS mean FROM events GROUP BY 1, 2) SELECT user_id, phase, mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, phase) AS k FROM m) WHERE k = 1")
def win10_rhythm(spark, d):
    return decide.rhythm(t(spark, d, "events"), "user_id", "event_id", "value", 7)


@query(f"SELECT source, id, round_even(x * (2778.0::DOUBLE / 1389.0::DOUBLE), 0)::INTEGER AS px, round_even(h * (642.0::DOUBLE / 1284.0::DOUBLE), 0)::INTEGER AS ph FROM ({BOXES})")
def prj4_projected(spark, d):
    r = F.col("rect")
    wide = G.projected(r, F.lit(1389.0), F.lit(1284.0), F.lit(2778.0), F.lit(642.0))
    return _boxes(spark, d).select("source", "id", wide["x"].alias("px"), wide["h"].alias("ph"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 100 >= 1 THEN c_custkey % 100 END AS lv FROM customer")
def str14_short_level(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select("c_custkey", text.short_level(F.concat(F.lit("Level "), (k % 100).cast("string"))).cast("long").alias("lv"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '12345678' || (c_custkey % 10) WHEN c_custkey % 3 = 1 THEN '98765432' END AS uid FROM customer")
def str15_any_id(spark, d):
    k = F.col("c_custkey")
    texts = F.when(k % 3 == 0, F.array(F.lit("hello"), F.concat(F.lit("ID: 12345678"), (k % 10).cast("string")))).when(k % 3 == 1, F.array(F.lit("98765432"), F.lit("x"))).otherwise(F.array(F.lit("98765432"), F.lit("11112222")))
    return t(spark, d, "customer").select("c_custkey", text.any_id(texts, True).alias("uid"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 < 4 THEN ['M416', 'AUG', 'UMP', 'AKM'][p_partkey % 10 + 1] WHEN p_partkey % 10 = 9 THEN 'AKM' END AS name FROM part")
def str13_priority_names(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in NAMED]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", text.priority_name(s).alias("name"))


@query("SELECT n_nationkey, '{\"a\":\"' || n_name || '\",\"b\":\"' || n_regionkey || '\"}' AS j FROM nation")
def js1_canonical_json(spark, d):
    m = F.create_map(F.lit("b"), F.col("n_regionkey").cast("string"), F.lit("a"), F.col("n_name"))
    return t(spark, d, "nation").select("n_nationkey", text.canonical_json(m).alias("j"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'guns' WHEN 1 THEN 'cars' END AS g FROM customer")
def src12_folder_groups(spark, d):
    p = F.element_at(F.array(F.lit("/in/xe/Sung 1/a"), F.lit("/in/sung1/XE/b"), F.lit("/in/other/c")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t(spark, d, "customer").select("c_custkey", catalog.group_of_folder(p, {"sung1": "guns", "xe": "cars"}).alias("g"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0")
def src10_inputs(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lpad(k.cast("string"), 10, "A"), F.lit(".png"))).otherwise(F.concat(F.lit("shot_"), k.cast("string"), F.lit(".JPG")))
    return catalog.inputs_of(t(spark, d, "customer").select("c_custkey", name.alias("filename"))).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity::INTEGER % 5 = 0 AS missing, l_returnflag = 'R' OR l_linenumber = 3 AS failed, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS size FROM lineitem")
def dec15_row_status(spark, d):
    c = F.col
    s = decide.row_status(F.when(c("l_quantity").cast("int") % 5 != 0, "n"), F.when(c("l_linenumber") != 3, 1), c("l_returnflag") == "R")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s["missing"].alias("missing"), s["failed"].alias("failed"), decide.odd_size(c("l_linenumber")).alias("size"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def st6_listed(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return review.listed(o, status="O", priority="1-URGENT").select("o_orderkey")


@query("SELECT l_orderkey AS source_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def st8_recategorised(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), "l_linenumber")
    changed = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source_id"))
    return review.recategorised(changed, assets=lines)["assets"]


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part WHERE p_size > 10) WHERE k <= 6")
def top2_first_six(spark, d):
    return ordering.first_of_each(t(spark, d, "part").where("p_size > 10"), "p_brand", ["p_retailprice", "p_partkey"], 6).select("p_brand", "p_partkey")


@query("""
WITH b AS (SELECT l_orderkey AS src, l_linenumber AS id, l_linenumber % 2 = 1 AS lab, (l_partkey % 600)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, (20 + l_quantity)::DOUBLE AS w, 12.0::DOUBLE AS h FROM lineitem)
SELECT a.src, a.id AS label_id, min(c.id) AS digit_id FROM b a JOIN b c ON a.src = c.src AND a.lab AND NOT c.lab AND c.x - (a.x + a.w) BETWEEN 0 AND greatest(25.0::DOUBLE, 4.0::DOUBLE * a.h) AND abs((c.y + c.h / 2) - (a.y + a.h / 2)) <= greatest(5.0::DOUBLE, 0.7::DOUBLE * a.h) GROUP BY 1, 2
""")
def jn7_first_split_box(spark, d):
    from quiltframe.operators.boxes import split_pairs

    c = F.col
    b = t(spark, d, "lineitem").select(c("l_orderkey").alias("src"), c("l_linenumber").alias("id"), (c("l_linenumber") % 2 == 1).alias("lab"), (c("l_partkey") % 600).cast("double").alias("x"), (c("l_suppkey") % 40).cast("double").alias("y"), (20 + c("l_quantity")).alias("w"), F.lit(12.0).alias("h"))
    pairs = split_pairs(b.where("lab"), b.where("not lab"), "src", gap=(25.0, 4.0), shift=(5.0, 0.7), overlap=0.0)
    return pairs.groupBy("src", "label_id").agg(F.min("digit_id").alias("digit_id"))
