"""Scans, sinks, filters, joins, set operations, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import day as D
from tidewater.operators.joins import restrict
from tidewater.operators.windows import numbered
from tidewater.sources import tables as T
from tidewater.sources.scratch import shared_folder
from tidewater.sources.tables import read, sensor

from .common import DAY, KEYS, SENSOR, SPINE, shown, spine
from .registry import query


@query("q_S1_pruned_scan", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.02")
def pruned_scan(spark, sf_dir):
    return shown(read(spark, sf_dir, "lineitem", "l_quantity >= 45 and l_discount < 0.02").select("l_orderkey", "l_linenumber", "l_quantity"))


@query("q_S2_csv_scan", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def csv_scan(spark, sf_dir):
    path = f"{shared_folder(spark)}/csv"
    rows = read(spark, sf_dir, "orders", "o_orderpriority = '1-URGENT'").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    rows.write.option("header", True).csv(path)
    return shown(T.read_csv(spark, path, "o_orderkey LONG, o_orderdate DATE, o_totalprice DOUBLE"))


@query("q_S3_array_loader", """
SELECT vec_id, round(list_avg(list_filter(embedding, lambda x: x > 0.1)::DOUBLE[]), 6) AS hr FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.1)) > 0""")
def array_loader(spark, sf_dir):
    some = F.filter("embedding", lambda x: x > 0.1)
    return shown(read(spark, sf_dir, "embeddings").select("vec_id", S.array_mean(some).alias("hr")).dropna(subset=["hr"]))


@query("q_S4_key_spine", f"WITH {SENSOR}, {SPINE} SELECT user_id, {DAY}, split FROM spine")
def key_spine(spark, sf_dir):
    days = spine(spark, sf_dir)
    return shown(T.key_spine(days.filter("split = 'train'"), days.filter("split = 'sub'"), KEYS))


@query("q_S5_feature_split", f"WITH {SENSOR} SELECT user_id, {DAY}, round(avg(value), 6) AS v, count(*) AS n FROM s WHERE s.day <= DATE '2024-01-20' GROUP BY user_id, s.day")
def feature_split(spark, sf_dir):
    table = spine(spark, sf_dir).join(sensor(spark, sf_dir).groupBy(*KEYS).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")), KEYS)
    train, _, features = T.read_features(table, KEYS, [])
    return shown(train.select(*KEYS, *features))


@query("q_S7_S12_parquet_sink", f"WITH {SENSOR}, {SPINE} SELECT split, count(*) AS n, count(DISTINCT user_id) AS users FROM spine GROUP BY split")
def parquet_sink(spark, sf_dir):
    path = f"{shared_folder(spark)}/spine"
    T.write_checked(spine(spark, sf_dir), path, partition_by=["split"])
    again = T.write_checked(spine(spark, sf_dir), path, partition_by=["split"], reuse=True)
    return shown(again.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")))


@query("q_S9_csv_sink", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_sink(spark, sf_dir):
    path = f"{shared_folder(spark)}/out"
    named = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    T.write_csv(named, path, ["n_name"])
    return T.read_csv(spark, path, "n_name STRING, r_name STRING")


@query("q_P2_P5_time_filters", """
SELECT event_id, strftime(ts::DATE, '%Y-%m-%d') AS day, hour(ts)::BIGINT AS h FROM events
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' AND hour(ts) BETWEEN 18 AND 20""")
def time_filters(spark, sf_dir):
    # The range on the raw column reaches the scan; the hour does not.
    rows = read(spark, sf_dir, "events").filter("ts >= timestamp_ntz'2024-01-10 00:00:00' and ts < timestamp_ntz'2024-01-12 00:00:00'")
    return shown(rows.filter(F.hour("ts").between(18, 20)).select("event_id", F.to_date("ts").alias("day"), F.hour("ts").alias("h")))


@query("q_P6_P7_clamp_and_sentinel", f"WITH {SENSOR} SELECT event_id, value, nullif(k, 0)::DOUBLE AS k FROM s WHERE value BETWEEN 30 AND 200")
def clamp_and_sentinel(spark, sf_dir):
    return shown(sensor(spark, sf_dir).filter(F.col("value").between(30, 200)).select("event_id", "value", F.nullif("k", F.lit(0)).cast("double").alias("k")))


@query("q_P10_night_keys", """
SELECT event_id, strftime(CASE WHEN hour(ts) >= 21 THEN ts::DATE ELSE ts::DATE - 1 END::DATE, '%Y-%m-%d') AS night, ((hour(ts) * 60 + minute(ts) - 1260 + 1440) % 1440)::BIGINT AS mw
FROM events WHERE hour(ts) >= 21 OR hour(ts) < 9""")
def night_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", S.night(F.col("ts")).alias("night"), S.minute_of_night(F.col("ts")).alias("mw"))
    return shown(rows.filter("night is not null"))


@query("q_P11_previous_day_keys", "SELECT strftime((ts::DATE - 1)::DATE, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE hour(ts) < 9 GROUP BY 1")
def previous_day_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(S.morning_after(F.col("ts")).alias("day")).filter("day is not null")
    return shown(rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")))


@query("q_P16_F16_clip_logit", """
WITH p AS (SELECT doc_id, least(greatest(n_chars / 20000.0::DOUBLE, 0.000001), 0.999999) AS p FROM documents)
SELECT doc_id, round(p, 6) AS p, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS back FROM p""")
def clip_logit(spark, sf_dir):
    p = S.clip(F.col("n_chars") / 20000.0, 1e-6, 1 - 1e-6)
    rows = read(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    return shown(rows.withColumn("logit", S.logit(F.col("p"))).withColumn("back", S.sigmoid(F.col("logit"))))


@query("q_P17_impute", f"""
WITH {SENSOR}, a AS (SELECT user_id, day, avg(value) FILTER (bucket = 'evening') AS x FROM s GROUP BY ALL),
m AS (SELECT user_id, quantile_cont(x, 0.5) AS own FROM a GROUP BY user_id), g AS (SELECT quantile_cont(x, 0.5) AS every FROM a)
SELECT user_id, {DAY}, round(coalesce(x, own, every), 6) AS x, (x IS NULL)::BIGINT AS fallback FROM a JOIN m USING (user_id) CROSS JOIN g""")
def impute(spark, sf_dir):
    from tidewater.operators.episodes import with_fallback

    daily = sensor(spark, sf_dir).groupBy(*KEYS).agg(F.avg(F.when(F.col("bucket") == "evening", F.col("value"))).alias("x"))
    return shown(with_fallback(daily.select(*KEYS), daily.filter("x is not null"), KEYS, "user_id", ["x"]))


@query("q_J1_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    rich = read(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return restrict(read(spark, sf_dir, "customer"), rich, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("q_J2_J3_left_joins", """
SELECT c_custkey, n_name, n_orders::DOUBLE AS n_orders, round(spent, 4) AS spent FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def left_joins(spark, sf_dir):
    spent = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    named = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    base = read(spark, sf_dir, "customer").join(named, "c_nationkey", "left")
    return shown(D.on_spine(base.select("c_custkey", "n_name"), ["c_custkey"], spent), 4)


@query("q_J4_full_outer_join", f"""
WITH {SENSOR}, a AS (SELECT user_id, day, count(*) AS clicks FROM s WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, day, count(*) AS views FROM s WHERE event_type = 'view' GROUP BY ALL)
SELECT user_id, {DAY}, coalesce(clicks, 0) AS clicks, coalesce(views, 0) AS views FROM a FULL JOIN b USING (user_id, day)""")
def full_outer_join(spark, sf_dir):
    rows = sensor(spark, sf_dir)
    a, b = (rows.filter(F.col("event_type") == t).groupBy(*KEYS).agg(F.count(F.lit(1)).alias(n)) for t, n in (("click", "clicks"), ("view", "views")))
    return shown(a.join(b, KEYS, "full_outer").select(*KEYS, F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("views", F.lit(0)).alias("views")))


@query("q_J6_dimension_join", """
SELECT s_suppkey, n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def dimension_join(spark, sf_dir):
    # Summed by supplier first: the dimensions are joined to one row each.
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    out = sums.join(read(spark, sf_dir, "supplier"), "s_suppkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return shown(out.select("s_suppkey", "n_name", "r_name", "revenue"), 2)


@query("q_J15_J17_aligned_output", f"""
WITH {SENSOR}, {SPINE}, a AS (SELECT user_id, day, avg(value) AS v FROM s GROUP BY ALL)
SELECT row_number() OVER (ORDER BY user_id, day) AS ordinal, user_id, {DAY}, round(v, 6) AS v FROM spine LEFT JOIN a USING (user_id, day) WHERE split = 'sub'""")
def aligned_output(spark, sf_dir):
    wanted = spine(spark, sf_dir).filter("split = 'sub'")
    daily = sensor(spark, sf_dir).groupBy(*KEYS).agg(F.avg("value").alias("v"))
    wanted = wanted.withColumn("key", F.col("user_id") * 1_000_000 + F.datediff("day", F.lit("1970-01-01").cast("date")))
    return shown(numbered(wanted, "key").join(daily, KEYS, "left").select("ordinal", *KEYS, "v"))


@query("q_J16_anchor_audit", f"""
WITH {SENSOR}, t AS (SELECT user_id, k, count(*) AS n FROM s WHERE day <= DATE '2024-01-20' GROUP BY user_id, k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, k) = 1),
f AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, k) = 1)
SELECT user_id, t.k::DOUBLE AS k_train, f.k::BIGINT AS k_full, t.k IS NOT DISTINCT FROM f.k AS same FROM f LEFT JOIN t USING (user_id)""")
def anchor_audit(spark, sf_dir):
    rows = sensor(spark, sf_dir)
    full = D.anchor(rows, "user_id", "k").select("user_id", F.col("anchor").cast("long").alias("k_full"))
    train = D.anchor(rows.filter("day <= date'2024-01-20'"), "user_id", "k").select("user_id", F.col("anchor").cast("double").alias("k_train"))
    return full.join(train, "user_id", "left").withColumn("same", F.col("k_train").eqNullSafe(F.col("k_full")))


@query("q_U1_U2_union_distinct", "SELECT DISTINCT nationkey::BIGINT AS nationkey FROM (SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def union_distinct(spark, sf_dir):
    a = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey"))
    return shown(a.unionByName(read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("nationkey"))).distinct())


@query("q_U4_intersect_except", """
(SELECT o_custkey AS custkey, 'both' AS side FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderpriority = '5-LOW')
UNION ALL (SELECT o_custkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey, 'urgent' FROM orders WHERE o_orderpriority = '5-LOW')""")
def intersect_except(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    a, b = (orders.filter(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("custkey")) for p in ("1-URGENT", "5-LOW"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("urgent")))


@query("q_O3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("q_O4_largest_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5")
def largest_per_group(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return shown(D.top_per_group(rows, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 5))


@query("q_O5_most_common", "SELECT p_brand, count(*) AS n, max(p_retailprice) AS top_price FROM part GROUP BY p_brand ORDER BY n DESC, top_price DESC, p_brand LIMIT 10")
def most_common(spark, sf_dir):
    by = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("top_price"))
    return by.orderBy(F.desc("n"), F.desc("top_price"), "p_brand").limit(10)


@query("q_O7_W12_first_per_group", "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_group(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    first = rows.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    return shown(first.select("o_custkey", F.col("f.o_orderkey").alias("o_orderkey"), F.to_date("f.o_orderdate").alias("day")))


@query("q_F2_F3_arithmetic", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(ln(l_extendedprice), 6) AS ln_price, round(sqrt(l_quantity), 6) AS root, round(abs(l_discount - l_tax), 6) AS gap,
       round(pow(l_quantity, 2), 6) AS square, round_even(l_extendedprice / 1000.0::DOUBLE, 0)::BIGINT AS cell FROM lineitem""")
def arithmetic(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return shown(rows.select(
        "l_orderkey", "l_linenumber", F.log("l_extendedprice").alias("ln_price"), F.sqrt("l_quantity").alias("root"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        F.pow("l_quantity", F.lit(2.0)).alias("square"), S.grid_cell(F.col("l_extendedprice"), 1000.0).alias("cell"),
    ))


@query("q_F4_F6_time_functions", """
SELECT event_id, (hour(ts) * 60 + minute(ts))::BIGINT AS minute, (epoch_us(ts) // 60000000)::BIGINT AS floor_minute, ((hour(ts) * 60 + minute(ts)) // 5)::BIGINT AS bin5,
       datediff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS days, strftime((ts::DATE + 3)::DATE, '%Y-%m-%d') AS later FROM events""")
def time_functions(spark, sf_dir):
    minute = S.minute_of_day(F.col("ts"))
    return shown(read(spark, sf_dir, "events").select(
        "event_id", minute.alias("minute"), S.floor_minute(F.col("ts")).alias("floor_minute"), F.floor(minute / 5).alias("bin5"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("days"), F.date_add(F.to_date("ts"), 3).alias("later"),
    ))


@query("q_F5_calendar", """
SELECT o_orderkey, (isodow(o_orderdate) - 1)::BIGINT AS dow, (isodow(o_orderdate) >= 6)::BIGINT AS weekend, (isodow(o_orderdate) IN (5, 6))::BIGINT AS free, month(o_orderdate)::BIGINT AS month FROM orders""")
def calendar(spark, sf_dir):
    dow = F.weekday("o_orderdate")
    return shown(read(spark, sf_dir, "orders").select(
        "o_orderkey", dow.alias("dow"), (dow >= 5).cast("int").alias("weekend"), dow.isin(4, 5).cast("int").alias("free"), F.month("o_orderdate").alias("month")
    ))


@query("q_F8_string_functions", """
SELECT doc_id, lower(source) AS source, starts_with(text, 'A') AS starts, ends_with(text, '.') AS ends, contains(text, 'the') AS has, regexp_matches(text, '[0-9]{3}') AS digits,
       length(regexp_replace(text, '[aeiou]', '', 'g')) AS consonants FROM documents""")
def string_functions(spark, sf_dir):
    text = F.col("text")
    return shown(read(spark, sf_dir, "documents").select(
        "doc_id", F.lower("source").alias("source"), text.startswith("A").alias("starts"), text.endswith(".").alias("ends"), text.contains("the").alias("has"),
        text.rlike("[0-9]{3}").alias("digits"), F.length(F.regexp_replace(text, "[aeiou]", "")).alias("consonants"),
    ))


@query("q_F9_F12_nested", """
SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, min_by(role, turn) AS first_role, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY conv_id""")
def nested(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("chars")))).alias("t"))
    return shown(chats.select(
        "conv_id", F.size("t").alias("turns"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["chars"], F.lit(0))).alias("chars"),
        F.element_at("t", 1)["role"].alias("first_role"), F.size(F.filter("t", lambda x: x["role"] == "user")).alias("user_turns"),
    ))


@query("q_F10_F11_F13_explode", f"""
WITH {SENSOR} SELECT word, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS total FROM (SELECT unnest(string_split(event_type || ' ' || k::VARCHAR, ' ')) AS word, k FROM s) GROUP BY word""")
def explode(spark, sf_dir):
    parsed = read(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k STRING")).withColumn("k", F.expr("try_cast(p.k as int)"))
    words = parsed.select(F.explode(F.split(F.concat_ws(" ", "event_type", "k"), " ")).alias("word"), "k")
    return shown(words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total")))


@query("q_F14_interactions", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity * l_discount, 6) AS quantity_x_discount, round(l_quantity * l_tax, 6) AS quantity_x_tax, round(l_discount * l_tax, 6) AS discount_x_tax,
       round(l_quantity - l_discount, 6) AS quantity_d_discount, round(l_quantity - l_tax, 6) AS quantity_d_tax, round(l_discount - l_tax, 6) + 0.0 AS discount_d_tax FROM lineitem WHERE l_returnflag = 'R'""")
def interactions(spark, sf_dir):
    from tidewater.operators.stats import pairwise

    rows = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").withColumnsRenamed({f"l_{c}": c for c in ("quantity", "discount", "tax")})
    return shown(pairwise(rows, ["quantity", "discount", "tax"]).drop("quantity", "discount", "tax").select(
        "l_orderkey", "l_linenumber", *(f"{a}_{o}_{b}" for o in "xd" for a, b in (("quantity", "discount"), ("quantity", "tax"), ("discount", "tax")))
    ))
