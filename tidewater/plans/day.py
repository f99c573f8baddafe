"""Daily features of the event stream: the reference's feature blocks on (user, day)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.scalars import array_mean, clean, grid_cell, log1p_positive, lookup
from tidewater.operators import day as D
from tidewater.operators.joins import restrict
from tidewater.sources.tables import read, sensor

from .common import DAY, KEYS, SENSOR, SPINE, TYPES, means_by_bucket, shown, spine, with_split
from .registry import query

_BUCKETS = ("overnight", "morning", "afternoon", "evening")


@query("q_A1_day_scalar_stats", f"""
WITH {SENSOR}, {SPINE}, a AS (
  SELECT user_id, day, round(avg(value), 6) AS v_mean, round(stddev_samp(value), 6) AS v_std, round(min(value), 6) AS v_min, round(max(value), 6) AS v_max,
         round(quantile_cont(value, 0.25), 6) AS v_p25, round(quantile_cont(value, 0.5), 6) AS v_p50, round(quantile_cont(value, 0.75), 6) AS v_p75,
         {means_by_bucket('value', 'v')}
  FROM s GROUP BY user_id, day)
SELECT user_id, {DAY}, split, v_mean, v_std, v_min, v_max, v_p25, v_p50, v_p75, v_overnight, v_morning, v_afternoon, v_evening
FROM spine LEFT JOIN a USING (user_id, day)""")
def day_scalar_stats(spark, sf_dir):
    # The spine is the days with rows, so the groups are its rows already.
    return shown(with_split(D.scalar_stats(sensor(spark, sf_dir), KEYS, "value", "v")))


@query("q_A2_missing_flag", f"""
WITH {SENSOR}, users AS (SELECT DISTINCT user_id FROM s), days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day)
SELECT u.user_id, strftime(d.day, '%Y-%m-%d') AS day,
       CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id AND s.day = d.day) THEN 0 ELSE 1 END::BIGINT AS missing
FROM users u, days d""")
def missing_flag(spark, sf_dir):
    rows = sensor(spark, sf_dir)
    month = F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-30')"))
    return shown(D.missing_flag(rows.select("user_id").distinct().withColumn("day", month), rows, KEYS, "missing"))


@query("q_A3_binary_ratios", f"WITH {SENSOR} SELECT user_id, {DAY}, round(avg((event_type = 'click')::INT), 6) AS click_ratio, {means_by_bucket(chr(40) + 'event_type = ' + chr(39) + 'click' + chr(39) + ')::INT', 'click_ratio')} FROM s GROUP BY user_id, s.day")
def binary_ratios(spark, sf_dir):
    return shown(D.ratios(sensor(spark, sf_dir), KEYS, F.col("event_type") == "click", "click"))


@query("q_A4_category_share", f"WITH {SENSOR} SELECT user_id, {DAY}, " + ", ".join(f"round(avg((event_type = '{t}')::INT), 6) AS share_{t}" for t in ("click", "view", "error")) + " FROM s GROUP BY user_id, s.day")
def category_share(spark, sf_dir):
    return shown(D.shares(sensor(spark, sf_dir), KEYS, "event_type", ["click", "view", "error"], "share"))


@query("q_A5_active_ratio", f"WITH {SENSOR} SELECT user_id, {DAY}, round(avg((value >= 10)::INT), 6) AS active_ratio, {means_by_bucket('(value >= 10)::INT', 'active_ratio')} FROM s GROUP BY user_id, s.day")
def active_ratio(spark, sf_dir):
    return shown(D.ratios(sensor(spark, sf_dir), KEYS, F.col("value") >= 10, "active"))


@query("q_A6_sums", f"WITH {SENSOR} SELECT user_id, {DAY}, round(sum(value), 6) AS step_sum, round(avg(value), 6) AS step_mean, max(value) AS step_max, count(*) FILTER (value >= 20) AS step_active, " + ", ".join(f"round(coalesce(sum(value) FILTER (bucket = '{b}'), 0), 6) AS step_sum_{b}" for b in _BUCKETS) + " FROM s GROUP BY user_id, s.day")
def sums(spark, sf_dir):
    return shown(D.sums(sensor(spark, sf_dir), KEYS, "value", "step", 20.0))


_SAMPLES = "SELECT label, vec_id, list_filter(list_transform(embedding, lambda x: 100 + x::DOUBLE * 400), lambda x: x BETWEEN 30 AND 200) AS hr FROM embeddings"


@query("q_A7_array_sample_stats", f"""
WITH a AS ({_SAMPLES}), x AS (SELECT label, unnest(hr) AS hr FROM a)
SELECT label::BIGINT AS label, round(avg(hr), 6) AS hr_mean, round(stddev_samp(hr), 6) AS hr_std, round(min(hr), 6) AS hr_min, round(max(hr), 6) AS hr_max,
       round(quantile_cont(hr, 0.25), 6) AS hr_p25, round(quantile_cont(hr, 0.5), 6) AS hr_p50, round(quantile_cont(hr, 0.75), 6) AS hr_p75 FROM x GROUP BY label""")
def array_sample_stats(spark, sf_dir):
    arrays = read(spark, sf_dir, "embeddings").withColumn("hr", F.transform("embedding", lambda x: 100 + x.cast("double") * 400))
    samples = arrays.select("label", F.explode(clean(F.col("hr"), 30, 200)).alias("hr"))
    return shown(D.scalar_stats(samples, ["label"], "hr", "hr", bucket=None))


@query("q_A8_array_minute_mean", f"""
WITH a AS ({_SAMPLES})
SELECT label::BIGINT AS label, round(avg(CASE WHEN len(hr) >= 50 THEN list_sum(hr) / len(hr) END), 6) AS hr_minute_mean, count(*) FILTER (len(hr) >= 50) AS n_minutes, count(*) AS n_rows
FROM a GROUP BY label""")
def array_minute_mean(spark, sf_dir):
    hr = F.transform("embedding", lambda x: 100 + x.cast("double") * 400)
    rows = read(spark, sf_dir, "embeddings").select("label", array_mean(clean(hr, 30, 200), 50).alias("m"))
    return shown(rows.groupBy("label").agg(F.avg("m").alias("hr_minute_mean"), F.count("m").alias("n_minutes"), F.count(F.lit(1)).alias("n_rows")))


_GROUPS = ["click", "error", "view"]


@query("q_A9_row_group_score", f"""
WITH {SENSOR}, r AS (SELECT user_id, day, h, """ + ", ".join(f"coalesce(max(value) FILTER (event_type = '{g}'), 0) AS {g}" for g in _GROUPS) + f"""
  FROM s WHERE event_type IN ('click', 'error', 'view') GROUP BY user_id, day, h)
SELECT user_id, {DAY}, """ + ", ".join(f"round(avg({g}), 6) AS score_{g}" for g in _GROUPS) + " FROM r GROUP BY user_id, r.day")
def row_group_score(spark, sf_dir):
    return shown(D.group_score(sensor(spark, sf_dir), KEYS, "h", "event_type", "value", _GROUPS, "score"))


@query("q_A10_bucket_group_score", f"""
WITH {SENSOR}, r AS (SELECT user_id, day, h, bucket, """ + ", ".join(f"coalesce(max(value) FILTER (event_type = '{g}'), 0) AS {g}" for g in _GROUPS) + f"""
  FROM s WHERE event_type IN ('click', 'error', 'view') GROUP BY user_id, day, h, bucket)
SELECT user_id, {DAY}, """ + ", ".join(f"round(avg({g}) FILTER (bucket = '{b}'), 6) AS score_{g}_{b}" for b in _BUCKETS for g in _GROUPS) + " FROM r GROUP BY user_id, r.day")
def bucket_group_score(spark, sf_dir):
    return shown(D.group_score(sensor(spark, sf_dir), KEYS, "h", "event_type", "value", _GROUPS, "score", bucket="bucket"))


@query("q_A11_entropy", """
WITH c AS (SELECT source, lang, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS p FROM c)
SELECT source, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, round(max(p), 6) AS top_share, count(*) AS n_labels FROM p GROUP BY source""")
def entropy(spark, sf_dir):
    return shown(D.entropy(read(spark, sf_dir, "documents").select("source", "lang"), ["source"], "lang"))


@query("q_A12_weighted_entropy", f"""
WITH {SENSOR}, c AS (SELECT user_id, day, event_type, sum(value) AS n FROM s GROUP BY ALL HAVING sum(value) > 0),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, day) AS p FROM c)
SELECT user_id, {DAY}, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, round(max(p), 6) AS top_share, count(*) AS n_labels FROM p GROUP BY user_id, p.day""")
def weighted_entropy(spark, sf_dir):
    return shown(D.entropy(sensor(spark, sf_dir), KEYS, "event_type", "value"))


@query("q_A13_position_stats", f"""
WITH {SENSOR}, g AS (SELECT *, k / 100.0::DOUBLE AS lat, event_id % 180 AS lon FROM s)
SELECT user_id, {DAY}, round(avg(value), 6) AS speed_mean, max(value) AS speed_max, round(stddev_samp(value), 6) AS speed_std, round(stddev_samp(lat), 6) AS lat_std,
       count(*) AS n, round(avg((value < 5)::INT), 6) AS stationary, count(DISTINCT (round_even(lat / 0.05, 0), lon)) AS n_places
FROM g GROUP BY user_id, g.day""")
def position_stats(spark, sf_dir):
    rows = sensor(spark, sf_dir).withColumn("lat", F.col("k") / 100.0).withColumn("lon", F.col("event_id") % 180)
    return shown(rows.groupBy(*KEYS).agg(
        F.avg("value").alias("speed_mean"), F.max("value").alias("speed_max"), F.stddev_samp("value").alias("speed_std"), F.stddev_samp("lat").alias("lat_std"),
        F.count(F.lit(1)).alias("n"), F.avg((F.col("value") < 5).cast("double")).alias("stationary"),
        F.count_distinct(F.struct(grid_cell(F.col("lat"), 0.05), "lon")).alias("n_places"),
    ))


@query("q_A14_A15_distinct_and_top_share", f"""
WITH {SENSOR}, c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS n_distinct, round(max(n) / sum(n), 6) AS top_share FROM c GROUP BY user_id""")
def distinct_and_top_share(spark, sf_dir):
    counts = sensor(spark, sf_dir).groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))
    return shown(counts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_distinct"), (F.max("n") / F.sum("n")).alias("top_share")))


_HOME = "c AS (SELECT user_id, k, count(*) AS n FROM s WHERE day <= DATE '2024-01-20' GROUP BY ALL), home AS (SELECT user_id, k AS anchor, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) = 1)"


@query("q_A16_home_anchor", f"WITH {SENSOR}, {_HOME} SELECT user_id, anchor::BIGINT AS anchor, n FROM home")
def home_anchor(spark, sf_dir):
    return shown(D.anchor(sensor(spark, sf_dir).filter("day <= date'2024-01-20'"), "user_id", "k"))


@query("q_A17_home_ratio", f"""
WITH {SENSOR}, {_HOME}, x AS (SELECT s.*, coalesce(k = anchor, false)::INT AS here FROM s LEFT JOIN home USING (user_id))
SELECT user_id, {DAY}, round(avg(here), 6) AS home_ratio, round(avg(here) FILTER (bucket = 'evening'), 6) AS home_evening, round(avg(here) FILTER (bucket = 'overnight'), 6) AS home_overnight
FROM x GROUP BY user_id, x.day""")
def home_ratio(spark, sf_dir):
    rows = sensor(spark, sf_dir)
    return shown(D.at_anchor(rows, KEYS, "user_id", "k", D.anchor(rows.filter("day <= date'2024-01-20'"), "user_id", "k")))


@query("q_A18_scan_home_ratio", f"""
WITH {SENSOR}, {_HOME}, x AS (SELECT user_id, day, h, max(coalesce(k = anchor, false)::INT) AS here FROM s LEFT JOIN home USING (user_id) GROUP BY user_id, day, h)
SELECT user_id, {DAY}, round(avg(here), 6) AS home_ratio, count(*) AS n_scans FROM x GROUP BY user_id, x.day""")
def scan_home_ratio(spark, sf_dir):
    rows = sensor(spark, sf_dir)
    return shown(D.scan_at_anchor(rows, KEYS, "user_id", "h", "k", D.anchor(rows.filter("day <= date'2024-01-20'"), "user_id", "k")))


@query("q_A19_sentinel_stats", f"""
WITH {SENSOR} SELECT user_id, {DAY}, round(avg(nullif(k, 0)), 6) AS rssi_mean, max(nullif(k, 0))::DOUBLE AS rssi_max, round(stddev_samp(nullif(k, 0)), 6) AS rssi_std, count(nullif(k, 0)) AS n
FROM s GROUP BY user_id, s.day""")
def sentinel_stats(spark, sf_dir):
    rssi = F.nullif(F.col("k"), F.lit(0))
    return shown(sensor(spark, sf_dir).withColumn("rssi", rssi).groupBy(*KEYS).agg(
        F.avg("rssi").alias("rssi_mean"), F.max("rssi").cast("double").alias("rssi_max"), F.stddev_samp("rssi").alias("rssi_std"), F.count("rssi").alias("n")
    ))


@query("q_A20_usage_totals", f"""
WITH {SENSOR} SELECT user_id, {DAY}, round(sum(value), 6) AS total, round(coalesce(sum(value) FILTER (h BETWEEN 21 AND 23), 0), 6) AS pre_bed,
  round(coalesce(sum(value) FILTER (h >= 22), 0), 6) AS late, count(DISTINCT event_type) AS apps FROM s GROUP BY user_id, s.day""")
def usage_totals(spark, sf_dir):
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return shown(sensor(spark, sf_dir).groupBy(*KEYS).agg(
        zero(F.col("value")).alias("total"), zero(F.when(F.col("h").between(21, 23), F.col("value"))).alias("pre_bed"),
        zero(F.when(F.col("h") >= 22, F.col("value"))).alias("late"), F.count_distinct("event_type").alias("apps"),
    ))


@query("q_A21_evening_split", f"""
WITH {SENSOR} SELECT user_id, {DAY}, round(avg(value) FILTER (h BETWEEN 18 AND 20), 6) AS early_mean, max(value) FILTER (h BETWEEN 18 AND 20) AS early_max,
  round(avg(value) FILTER (h BETWEEN 21 AND 23), 6) AS late_mean, max(value) FILTER (h BETWEEN 21 AND 23) AS late_max,
  round(CASE WHEN max(value) FILTER (h BETWEEN 21 AND 23) IS NOT NULL THEN ln(1 + greatest(max(value) FILTER (h BETWEEN 21 AND 23), 0)) END, 6) AS late_log FROM s GROUP BY user_id, s.day""")
def evening_split(spark, sf_dir):
    split = D.split_stats(sensor(spark, sf_dir), KEYS, "h", "value", {"early": (18, 20), "late": (21, 23)})
    return shown(split.withColumn("late_log", log1p_positive(F.col("late_max"))))


@query("q_A22_resting_quantile", "SELECT user_id, round(quantile_cont(value, 0.1), 6) AS resting FROM events GROUP BY user_id")
def resting_quantile(spark, sf_dir):
    return shown(read(spark, sf_dir, "events").groupBy("user_id").agg(F.percentile("value", 0.1).alias("resting")))


@query("q_A23_gated_sleep_window", f"""
WITH {SENSOR}, m AS (SELECT user_id, day - 1 AS day, value FROM s WHERE h < 9)
SELECT user_id, strftime(day::DATE, '%Y-%m-%d') AS day, count(value) AS n, round(CASE WHEN count(value) > 1 THEN avg(value) END, 6) AS mean,
  round(CASE WHEN count(value) > 1 THEN stddev_samp(value) END, 6) AS std, CASE WHEN count(value) > 1 THEN min(value) END AS min, CASE WHEN count(value) > 1 THEN max(value) END AS max
FROM m GROUP BY user_id, m.day""")
def gated_sleep_window(spark, sf_dir):
    from tidewater.functions.scalars import morning_after

    rows = read(spark, sf_dir, "events").withColumn("day", morning_after(F.col("ts"))).filter("day is not null")
    return shown(D.gated(rows, KEYS, "value", 1))


@query("q_A29_A30_demeaned", f"""
WITH {SENSOR}, a AS (SELECT user_id, day, avg(value) AS v, count(*)::DOUBLE AS n FROM s GROUP BY ALL)
SELECT user_id, {DAY}, round(v, 8) AS v, n, round(v - avg(v) OVER (PARTITION BY user_id), 8) + 0.0 AS v_w, round(n - avg(n) OVER (PARTITION BY user_id), 8) + 0.0 AS n_w FROM a""")
def demeaned(spark, sf_dir):
    daily = sensor(spark, sf_dir).groupBy(*KEYS).agg(F.avg("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    return shown(D.demeaned(daily, "user_id", ["v", "n"]), 8)


@query("q_A31_missing_rates", f"""
WITH {SENSOR}, a AS (SELECT user_id, day, {", ".join(f"avg(value) FILTER (bucket = '{b}') AS {b}" for b in _BUCKETS)} FROM s GROUP BY ALL)
""" + " UNION ALL ".join(f"SELECT user_id, '{b}' AS \"column\", round(avg(({b} IS NULL)::INT), 6) AS missing FROM a GROUP BY user_id" for b in _BUCKETS))
def missing_rates(spark, sf_dir):
    daily = sensor(spark, sf_dir).groupBy(*KEYS).agg(*(F.avg(F.when(F.col("bucket") == b, F.col("value"))).alias(b) for b in _BUCKETS))
    return shown(D.missing_rates(daily, "user_id", list(_BUCKETS)))


@query("q_A35_described", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.5), 4) AS p50, max({c})::DOUBLE AS max FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount")
))
def described(spark, sf_dir):
    return shown(D.described(read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"]), 4)


@query("q_P8_class_groups", f"""
WITH {SENSOR}, g AS (SELECT *, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'touch' WHEN 'purchase' THEN 'money' ELSE 'other' END AS grp FROM s)
SELECT user_id, grp, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, grp""")
def class_groups(spark, sf_dir):
    grp = lookup(F.col("event_type"), {"click": "touch", "view": "touch", "purchase": "money"}, "other")
    return shown(sensor(spark, sf_dir).withColumn("grp", grp).groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("q_F15_pivot", f"WITH {SENSOR} SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in TYPES) + " FROM s GROUP BY user_id")
def pivot(spark, sf_dir):
    wide = sensor(spark, sf_dir).groupBy("user_id").pivot("event_type", TYPES).agg(F.count(F.lit(1)))
    return shown(wide.select("user_id", *(F.coalesce(F.col(t), F.lit(0)).alias(f"n_{t}") for t in TYPES)))
