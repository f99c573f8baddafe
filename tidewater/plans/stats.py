"""Within and between subjects, blends of predictions, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import joins as J, ranks as R, stats as Q
from tidewater.operators.interactions import Interactions
from tidewater.sources import contract as C
from tidewater.sources.scratch import shared_folder, written
from tidewater.sources.tables import read, read_groups, sensor, write_groups

from .common import DAY, KEYS, SENSOR, shown
from .registry import query

_FEATURES = ("n", "k_mean", "h_mean")
_LONG_SQL = """d AS (SELECT user_id, day, (avg(value) > 12)::INT AS y, count(*)::DOUBLE AS n, avg(k)::DOUBLE AS k_mean, avg(h)::DOUBLE AS h_mean FROM s GROUP BY ALL),
l AS (""" + " UNION ALL ".join(f"SELECT user_id, day, y, '{f}' AS feature, {f} AS x FROM d" for f in _FEATURES) + ")"


def _wide(spark, sf_dir):
    return written(sensor(spark, sf_dir).groupBy(*KEYS).agg(
        (F.avg("value") > 12).cast("int").alias("y"), F.count(F.lit(1)).cast("double").alias("n"), F.avg("k").alias("k_mean"), F.avg("h").alias("h_mean")
    ))


def _long(spark, sf_dir):
    return _wide(spark, sf_dir).unpivot([*KEYS, "y"], list(_FEATURES), "feature", "x")


def _ranked(table: str, by: str) -> str:
    return f"""SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0::DOUBLE AS ry FROM {table}"""


@query("q_W10_W11_spearman", f"""
WITH x AS (SELECT lang, n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), r AS ({_ranked('x', 'lang')})
SELECT lang, round(corr(rx, ry), 6) AS r, count(*) AS n FROM r GROUP BY lang""")
def spearman(spark, sf_dir):
    both = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return shown(R.spearman(both, ["lang"], "n_chars", "quality"))


@query("q_M8_within_between", f"""
WITH {SENSOR}, {_LONG_SQL}, w0 AS (SELECT feature, round(x - avg(x) OVER (PARTITION BY user_id, feature), 9) AS x, round(y - avg(y) OVER (PARTITION BY user_id, feature), 9) AS y FROM l),
r AS ({_ranked('l', 'feature')}), w AS ({_ranked('w0', 'feature')}), a AS (SELECT feature, corr(rx, ry) AS raw, count(*) AS n FROM r GROUP BY feature), b AS (SELECT feature, corr(rx, ry) AS within FROM w GROUP BY feature)
SELECT feature, round(raw, 6) AS raw, n, round(within, 6) AS within, CASE WHEN raw IS NULL OR abs(raw) < 0.02 THEN 'weak' WHEN abs(coalesce(within, 0)) >= 0.7 * abs(raw) THEN 'day_rich' WHEN abs(coalesce(within, 0)) <= 0.3 * abs(raw) THEN 'between_only' ELSE 'mixed' END AS kind
FROM a LEFT JOIN b USING (feature)""")
def within_between(spark, sf_dir):
    return shown(Q.within_between(_long(spark, sf_dir), "user_id", "feature", "x", "y", least=0.02))


@query("q_M9_mundlak", f"""
WITH {SENSOR}, {_LONG_SQL}, t AS (SELECT user_id, avg(n) AS nb, avg(k_mean) AS kb FROM d WHERE day <= DATE '2024-01-20' AND user_id % 5 > 0 GROUP BY user_id), g AS (SELECT quantile_cont(n, 0.5) AS n, quantile_cont(k_mean, 0.5) AS k FROM d WHERE day <= DATE '2024-01-20' AND user_id % 5 > 0)
SELECT user_id, {DAY}, round(coalesce(nb, g.n), 8) AS n_b, round(coalesce(kb, g.k), 8) AS k_mean_b, round(d.n - coalesce(nb, g.n), 8) + 0.0 AS n_w, round(d.k_mean - coalesce(kb, g.k), 8) + 0.0 AS k_mean_w FROM d LEFT JOIN t USING (user_id) CROSS JOIN g""")
def mundlak(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    out = Q.mundlak(wide.filter("day <= date'2024-01-20' and user_id % 5 > 0"), wide, "user_id", ["n", "k_mean"])
    return shown(out.select(*KEYS, "n_b", "k_mean_b", "n_w", "k_mean_w"), 8)


@query("q_M10_cross_bucket", f"""
WITH {SENSOR}, b AS (SELECT user_id, day, avg(value) FILTER (bucket = 'morning') AS vm, avg(value) FILTER (bucket = 'evening') AS ve, avg(k) FILTER (bucket = 'morning') AS km, avg(k) FILTER (bucket = 'evening') AS ke FROM s GROUP BY ALL)
SELECT user_id, {DAY}, round(vm * ke, 5) AS v_morning_x_k_evening, round(ve * km, 5) AS v_evening_x_k_morning, round(vm - ve, 6) AS v_morning_d_evening, round(km - ke, 6) AS k_morning_d_evening FROM b""")
def cross_bucket(spark, sf_dir):
    of = lambda c, b: F.avg(F.when(F.col("bucket") == b, F.col(c)))
    daily = sensor(spark, sf_dir).groupBy(*KEYS).agg(of("value", "morning").alias("vm"), of("value", "evening").alias("ve"), of("k", "morning").alias("km"), of("k", "evening").alias("ke"))
    out = Q.cross_bucket(daily, {"v": {"morning": "vm", "evening": "ve"}, "k": {"morning": "km", "evening": "ke"}})
    products = ["v_morning_x_k_evening", "v_evening_x_k_morning"]
    return shown(out.select(*KEYS, *(F.round(c, 5).alias(c) for c in products), "v_morning_d_evening", "k_morning_d_evening"))


@query("q_M26_sign_stability", f"""
WITH {SENSOR}, {_LONG_SQL}, f AS (SELECT *, user_id % 5 AS fold FROM l), r AS ({_ranked('f', 'feature, fold')}), c AS (SELECT feature, fold, corr(rx, ry) AS r FROM r GROUP BY ALL), m AS (SELECT feature, quantile_cont(r, 0.5) AS median_r FROM c GROUP BY feature)
SELECT feature, round(any_value(median_r), 6) AS median_r, round(avg(coalesce(sign(r) = sign(median_r), false)::INT), 6) AS agree FROM c JOIN m USING (feature) GROUP BY feature""")
def sign_stability(spark, sf_dir):
    return shown(Q.sign_stability(_long(spark, sf_dir).withColumn("fold", F.col("user_id") % 5), "fold", "feature", "x", "y"))


#: Two made-up predictors of the document labels, and three of the joined rows' labels in long form.
_PRED_SQL = """p AS (SELECT doc_id, quality AS y, doc_id % 5 AS fold, lang, 0.05 + 0.9 * (1 - least(n_chars, 6000) / 6000.0::DOUBLE) AS m, 0.1 + 0.8 * (doc_id % 97) / 97.0::DOUBLE AS n, 0.2 + 0.6 * quality + 0.1 * ((doc_id % 13) / 13.0::DOUBLE) AS q FROM documents JOIN labels USING (doc_id))"""


def _predictions(spark, sf_dir):
    both = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return both.select(
        "doc_id", F.col("quality").alias("y"), (F.col("doc_id") % 5).alias("fold"), "lang",
        (0.05 + 0.9 * (1 - F.least("n_chars", F.lit(6000)) / 6000.0)).alias("m"), (0.1 + 0.8 * (F.col("doc_id") % 97) / 97.0).alias("n"),
        (0.2 + 0.6 * F.col("quality") + 0.1 * ((F.col("doc_id") % 13) / 13.0)).alias("q"),
    )


@query("q_A34_log_loss", f"""
WITH {_PRED_SQL} SELECT lang, count(*) AS n, round(-avg(y * ln(m) + (1 - y) * ln(1 - m)), 6) AS loss_m, round(-avg(y * ln(n) + (1 - y) * ln(1 - n)), 6) AS loss_n FROM p GROUP BY lang""")
def log_loss(spark, sf_dir):
    y = F.col("y")
    return shown(_predictions(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), Q.log_loss(y, F.col("m")).alias("loss_m"), Q.log_loss(y, F.col("n")).alias("loss_n")))


@query("q_A32_blend_weight", f"""
WITH {_PRED_SQL}, v AS (SELECT lang, var_pop(m - y) AS vm, var_pop(q - y) AS vq, covar_pop(m - y, q - y) AS c FROM p GROUP BY lang)
SELECT lang, round(least(greatest((vm - c) / (vm + vq - 2 * c + 1e-12), 0), 1), 6) AS alpha FROM v""")
def blend_weight(spark, sf_dir):
    return shown(_predictions(spark, sf_dir).groupBy("lang").agg(Q.blend_weight(F.col("m"), F.col("q"), F.col("y")).alias("alpha")))


@query("q_M21_blend_out_of_fold", f"""
WITH {_PRED_SQL}, f AS (SELECT DISTINCT lang, fold FROM p), v AS (SELECT f.lang, f.fold, var_pop(m - y) AS vm, var_pop(n - y) AS vn, covar_pop(m - y, n - y) AS c FROM f LEFT JOIN p ON p.lang = f.lang AND p.fold <> f.fold GROUP BY ALL),
a AS (SELECT lang, fold, coalesce(least(greatest((vm - c) / (vm + vn - 2 * c + 1e-12), 0), 1), 0) AS alpha FROM v)
SELECT doc_id, round(alpha, 6) AS alpha, round((1 - alpha) * m + alpha * n, 6) AS blend FROM p JOIN a USING (lang, fold)""")
def blend_out_of_fold(spark, sf_dir):
    return shown(Q.blend_out_of_fold(_predictions(spark, sf_dir), "fold", "lang", "m", "n", "y").select("doc_id", "alpha", "blend"))


@query("q_A33_simplex_weights", f"""
WITH {_PRED_SQL}, e AS (SELECT m - y AS a, n - y AS b, q - y AS c FROM p),
s AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc FROM e),
q AS (SELECT sum(pow(pow(a - ma, 2) + pow(b - mb, 2) + pow(c - mc, 2), 2)) AS q FROM e, s),
k AS (SELECT s.*, (aa + bb + cc) / 3 AS mu, q - n * (aa * aa + bb * bb + cc * cc + 2 * (ab * ab + ac * ac + bc * bc)) AS spread FROM s, q),
h AS (SELECT *, least(1, greatest(0, spread / n / n / (pow(aa - mu, 2) + pow(bb - mu, 2) + pow(cc - mu, 2) + 2 * (ab * ab + ac * ac + bc * bc)))) AS h FROM k),
r AS (SELECT (1 - h) * aa + h * mu AS aa, (1 - h) * bb + h * mu AS bb, (1 - h) * cc + h * mu AS cc, (1 - h) * ab AS ab, (1 - h) * ac AS ac, (1 - h) * bc AS bc FROM h),
d AS (SELECT aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det, (bb * cc - bc * bc) - (ab * cc - bc * ac) + (ab * bc - bb * ac) AS x, -(ab * cc - ac * bc) + (aa * cc - ac * ac) - (aa * bc - ab * ac) AS y, (ab * bc - ac * bb) - (aa * bc - ac * ab) + (aa * bb - ab * ab) AS z FROM r),
w AS (SELECT greatest(x / det, 0) AS m, greatest(y / det, 0) AS n, greatest(z / det, 0) AS q FROM d)
SELECT 'm' AS view, round(m / (m + n + q), 6) AS weight FROM w UNION ALL SELECT 'n', round(n / (m + n + q), 6) FROM w UNION ALL SELECT 'q', round(q / (m + n + q), 6) FROM w""")
def simplex_weights(spark, sf_dir):
    weights = Q.simplex_weights(_predictions(spark, sf_dir), ["m", "n", "q"], "y")
    return spark.createDataFrame([(v, round(float(w), 6)) for v, w in zip("mnq", weights, strict=True)], "view string, weight double")


@query("q_M29_compared", f"""
WITH {_PRED_SQL} SELECT count(*) AS n, round(max(abs(m - n)), 6) AS max_delta, round(avg(abs(m - n) / least(n, 1 - n)), 6) AS loss_bound FROM p""")
def compared(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return shown(Q.compared(p.select("doc_id", F.col("m").alias("p")), p.select("doc_id", F.col("n").alias("p")), ["doc_id"], "p"))


_NEAR = """q AS (SELECT vec_id AS query, embedding AS qx FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query, vec_id AS item, list_sum(list_transform(list_zip(qx, embedding), lambda z: abs(z[1] - z[2])::DOUBLE)) AS distance FROM q JOIN embeddings ON vec_id <> query),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, item) AS rank FROM d QUALIFY rank <= 3)"""


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label")


@query("q_J14_O6_nearest", f"WITH {_NEAR} SELECT query, item, round(distance, 4) AS distance, rank FROM k")
def nearest(spark, sf_dir):
    items = _vectors(spark, sf_dir)
    return shown(J.nearest(items.filter("id % 50 = 0"), items, 3), 4)


@query("q_M18_borrow", f"WITH {_NEAR} SELECT query, round(avg(label), 6) AS borrowed FROM k JOIN embeddings ON vec_id = item GROUP BY query")
def borrow(spark, sf_dir):
    items = _vectors(spark, sf_dir)
    return shown(Q.borrow(items.filter("id % 50 = 0"), items, 3, "label"))


_SCALED = """e AS (SELECT vec_id, vec_id % 3 AS fold, embedding AS x, 0.2 + 0.6 * (label % 2) AS p FROM embeddings),
u AS (SELECT vec_id, fold, unnest(range(1, len(x) + 1)) AS i, unnest(x)::DOUBLE AS v FROM e),
st AS (SELECT f.fold AS f, i, avg(v) AS m, stddev_pop(v) + 0.000001 AS s FROM (SELECT unnest(range(3)) AS fold) f JOIN u ON u.fold <> f.fold GROUP BY ALL),
z AS (SELECT f, vec_id, fold, u.i, least(greatest((v - m) / s, -3), 3) AS z FROM u JOIN st ON st.i = u.i),
d AS (SELECT q.f AS fold, q.vec_id AS query, k.vec_id AS item, sum(abs(q.z - k.z)) AS distance FROM z q JOIN z k ON q.fold = q.f AND k.f = q.f AND k.fold <> q.f AND k.i = q.i WHERE q.vec_id % 50 = 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, item) AS rank FROM d QUALIFY rank <= 3)"""


@query("q_M18_leak_free_borrow", f"""
WITH {_SCALED} SELECT query, k.fold::BIGINT AS fold, round(sum(p / pow(distance + 0.000001, 2)) / sum(1 / pow(distance + 0.000001, 2)), 5) AS borrowed FROM k JOIN e ON e.vec_id = item GROUP BY ALL""")
def leak_free_borrow(spark, sf_dir):
    """Standardised and clipped by the other folds, neighbours of the other folds, weighted by the inverse square of distance."""
    items = _vectors(spark, sf_dir).withColumn("fold", (F.col("id") % 3).cast("int")).withColumn("p", 0.2 + 0.6 * (F.col("label") % 2))
    return shown(Q.leak_free_borrow(items, "fold", 3, F.col("id") % 50 == 0, 3, "p"), 5)


def _blend_sql(out: str, source: str, m: str, n: str) -> str:
    """Out-of-fold blend of two columns as two tables."""
    return f"""{out}_v AS (SELECT f.lang, f.fold, var_pop({m} - y) AS vm, var_pop({n} - y) AS vn, covar_pop({m} - y, {n} - y) AS c FROM (SELECT DISTINCT lang, fold FROM {source}) f LEFT JOIN {source} p ON p.lang = f.lang AND p.fold <> f.fold GROUP BY ALL),
{out} AS (SELECT p.*, (1 - a) * {m} + a * {n} AS {out}_p FROM {source} p JOIN (SELECT lang, fold, coalesce(least(greatest((vm - c) / (vm + vn - 2 * c + 1e-12), 0), 1), 0) AS a FROM {out}_v) USING (lang, fold))"""


@query("q_M21_fusion_tree", f"WITH {_PRED_SQL}, {_blend_sql('b', 'p', 'n', 'q')}, {_blend_sql('g', 'b', 'm', 'b_p')} SELECT doc_id, round(g_p, 6) AS fused FROM g")
def fusion_tree(spark, sf_dir):
    """A tree of pairwise blends: one predictor with the blend of two others."""
    return shown(Q.fused(_predictions(spark, sf_dir), "fold", "lang", ("m", ("n", "q")), "y").select("doc_id", "fused"))


_ROLES = f"""{_PRED_SQL}, r AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 > 0 THEN fold END AS fold, CASE WHEN doc_id % 7 > 0 THEN y END AS y, m, n, q FROM p)"""


def _roles(spark, sf_dir):
    """Every seventh document has neither fold nor label: the hold-out split."""
    known = F.col("doc_id") % 7 > 0
    return _predictions(spark, sf_dir).withColumns({"fold": F.when(known, F.col("fold")), "y": F.when(known, F.col("y"))})


def _role_blend(out: str, source: str, m: str, n: str) -> str:
    return f"""{out}_f AS (SELECT DISTINCT lang, fold FROM {source}),
{out}_v AS (SELECT f.lang, f.fold, var_pop({m} - y) AS vm, var_pop({n} - y) AS vn, covar_pop({m} - y, {n} - y) AS c FROM {out}_f f LEFT JOIN {source} p ON p.lang = f.lang AND p.fold IS NOT NULL AND p.fold IS DISTINCT FROM f.fold GROUP BY ALL),
{out} AS (SELECT p.*, (1 - a) * {m} + a * {n} AS {out}_p FROM {source} p JOIN (SELECT lang, fold, coalesce(least(greatest((vm - c) / (vm + vn - 2 * c + 1e-12), 0), 1), 0) AS a FROM {out}_v) v ON v.lang = p.lang AND v.fold IS NOT DISTINCT FROM p.fold)"""


@query("q_M21_fusion_with_sub", f"WITH {_ROLES}, {_role_blend('b', 'r', 'n', 'q')}, {_role_blend('g', 'b', 'm', 'b_p')} SELECT doc_id, CASE WHEN fold IS NULL THEN 'sub' ELSE 'oof' END AS role, round(g_p, 6) AS fused FROM g")
def fusion_with_sub(spark, sf_dir):
    """The tree of blends for rows out of fold, each by the other folds' weights, and for the hold-out split by those of all."""
    found = Q.fused(_roles(spark, sf_dir), "fold", "lang", ("m", ("n", "q")), "y")
    return shown(found.select("doc_id", F.when(F.col("fold").isNull(), "sub").otherwise("oof").alias("role"), "fused"))


@query("q_M21_M28_composed")
def composed(spark, sf_dir):
    """The whole composition: tree of blends, Platt's calibration and simplex weights for each label, both roles."""
    found = Q.composed(written(_roles(spark, sf_dir)), "fold", "lang", ("m", "q"), "n", "y")
    return shown(found.select("doc_id", "lang", F.when(F.col("fold").isNull(), "sub").otherwise("oof").alias("role"), "p"))


_BLEND_NEAR = """e AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 > 0 THEN vec_id % 3 END AS fold, embedding[1:8] AS x, 0.2 + 0.06 * (vec_id % 11) AS p, CASE WHEN vec_id % 5 > 0 THEN (label % 2) END AS y FROM embeddings),
u AS (SELECT id, fold, unnest(range(1, len(x) + 1)) AS i, unnest(x)::DOUBLE AS v FROM e),
f AS (SELECT unnest([0, 1, 2, NULL]) AS f),
st AS (SELECT f, i, avg(v) AS m, stddev_pop(v) + 0.000001 AS s FROM f JOIN u ON u.fold IS NOT NULL AND u.fold IS DISTINCT FROM f.f GROUP BY ALL),
z AS (SELECT f, id, fold, list(least(greatest((v - m) / s, -3), 3) ORDER BY u.i) AS z FROM u JOIN st ON st.i = u.i GROUP BY ALL),
d AS (SELECT q.f AS fold, q.id AS query, k.id AS item, list_sum(list_transform(list_zip(q.z, k.z), lambda t: abs(t[1] - t[2]))) AS distance FROM z q JOIN z k ON q.fold IS NOT DISTINCT FROM q.f AND k.f IS NOT DISTINCT FROM q.f AND k.fold IS NOT NULL AND k.fold IS DISTINCT FROM q.f),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, item) AS rank FROM d QUALIFY rank <= 3),
n AS (SELECT query AS id, avg(p) AS borrowed FROM k JOIN e ON e.id = item GROUP BY query),
w AS (SELECT e.*, borrowed FROM e JOIN n USING (id)),
v AS (SELECT f, var_pop(p - y) AS vm, var_pop(borrowed - y) AS vn, covar_pop(p - y, borrowed - y) AS c FROM f JOIN w ON w.fold IS NOT NULL AND w.fold IS DISTINCT FROM f.f GROUP BY f),
a AS (SELECT f, least(greatest((vm - c) / (vm + vn - 2 * c + 1e-12), 0), 1) AS alpha FROM v)"""


@query("q_M18_neighbour_blend", f"""
WITH {_BLEND_NEAR} SELECT id, fold::BIGINT AS fold, round(borrowed, 6) AS borrowed, round(alpha, 6) AS alpha, round((1 - alpha) * p + alpha * borrowed, 6) AS blend FROM w JOIN a ON a.f IS NOT DISTINCT FROM w.fold""")
def neighbour_blend(spark, sf_dir):
    """Neighbours of every row: of training rows in the other folds, of the hold-out split in all; then the blend of each."""
    return shown(Q.neighbour_blend(*_blend_tables(spark, sf_dir), "fold", 3, 3, "p", "y").drop("p"))


def _blend_tables(spark, sf_dir):
    items = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 8).alias("x"), (0.2 + 0.06 * (F.col("vec_id") % 11)).alias("p"), (F.col("label") % 2).alias("y"))
    items = items.withColumn("fold", (F.col("id") % 3).cast("int"))
    return items.filter("id % 5 > 0"), items.filter("id % 5 = 0").drop("fold", "y")


_SUBSETS = Q.random_subsets(8, members=2, seed=0)
_SUBSPACE_NEAR = _BLEND_NEAR.replace(
    "d AS (SELECT q.f AS fold,", f"s AS (SELECT unnest({[[i + 1 for i in s] for s in _SUBSETS]}) AS chosen),\nd AS (SELECT chosen, q.f AS fold,"
).replace("list_zip(q.z, k.z)", "list_zip(list_select(q.z, chosen), list_select(k.z, chosen))").replace("k.fold IS DISTINCT FROM q.f),", "k.fold IS DISTINCT FROM q.f CROSS JOIN s),").replace(
    "PARTITION BY query ORDER", "PARTITION BY chosen, query ORDER"
)


@query("q_M19_subspace_blend", f"""
WITH {_SUBSPACE_NEAR} SELECT id, fold::BIGINT AS fold, round(borrowed, 6) AS borrowed, round(alpha, 6) AS alpha, round((1 - alpha) * p + alpha * borrowed, 6) AS blend FROM w JOIN a ON a.f IS NOT DISTINCT FROM w.fold""")
def subspace_blend(spark, sf_dir):
    """The same with what is borrowed averaged over random subsets of the coordinates, two here."""
    return shown(Q.neighbour_blend(*_blend_tables(spark, sf_dir), "fold", 3, 3, "p", "y", subsets=_SUBSETS).drop("p"))


@query("q_M5_top_class", """
WITH t AS (SELECT vec_id, list_position(embedding[1:5], list_max(embedding[1:5])) AS place FROM embeddings) SELECT vec_id, CASE place WHEN 1 THEN 'speech' WHEN 2 THEN 'music' WHEN 3 THEN 'vehicle' WHEN 4 THEN 'inside' WHEN 5 THEN 'outside' END AS top FROM t""")
def top_class(spark, sf_dir):
    """The class with the largest share in each row; the first on ties, null without shares."""
    shares = F.slice("embedding", 1, 5)
    names = F.array(*map(F.lit, ("speech", "music", "vehicle", "inside", "outside")))
    at = F.array_position(shares, F.array_max(shares)).cast("int")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.when(at > 0, F.get(names, at - 1)).alias("top"))


@query("q_M19_subspace_borrow")
def subspace_borrow(spark, sf_dir):
    items = _vectors(spark, sf_dir)
    return shown(Q.subspace_borrow(items.filter("id % 50 = 0"), items, 64, "label"))


@query("q_S10_P15_column_groups", f"WITH {SENSOR}, {_LONG_SQL} SELECT 'mean' AS grp, 'h_mean' AS col UNION ALL SELECT 'mean', 'k_mean' UNION ALL SELECT 'other', 'n'")
def column_groups(spark, sf_dir):
    """The sidecar of a table's columns, written beside it and read again."""
    columns = [c for c in _wide(spark, sf_dir).columns if c not in (*KEYS, "y")]
    path = f"{shared_folder(spark)}/groups"
    write_groups(spark, {"mean": sorted(c for c in columns if c.endswith("_mean")), "other": sorted(c for c in columns if not c.endswith("_mean"))}, path)
    return spark.createDataFrame([(g, c) for g, cs in read_groups(spark, path).items() for c in cs], "grp string, col string")


@query("q_M11_interaction_ranking", f"""
WITH {SENSOR}, d AS (SELECT user_id, day, (avg(value) > 12)::INT AS y, count(*)::DOUBLE AS n, avg(k)::DOUBLE AS k_mean, avg(h)::DOUBLE AS h_mean FROM s GROUP BY ALL),
l AS (SELECT y, 'n_x_k_mean' AS feature, round(n * k_mean, 9) AS x FROM d UNION ALL SELECT y, 'n_x_h_mean', round(n * h_mean, 9) FROM d UNION ALL SELECT y, 'k_mean_x_h_mean', round(k_mean * h_mean, 9) FROM d),
r AS ({_ranked('l', 'feature')}), c AS (SELECT feature, corr(rx, ry) AS r FROM r GROUP BY feature)
SELECT feature, round(r, 6) AS r, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rank FROM c QUALIFY rank <= 2""")
def interaction_ranking(spark, sf_dir):
    """The two products of features that rank the label best."""
    from tidewater.operators.day import top_per_group

    products = Q.pairwise(_wide(spark, sf_dir), list(_FEATURES))
    names = [c for c in products.columns if "_x_" in c]
    long = products.select("y", *(F.round(c, 9).alias(c) for c in names)).unpivot("y", names, "feature", "x")
    found = R.spearman(long, ["feature"], "x", "y").withColumn("label", F.lit("y"))
    return shown(top_per_group(found, ["label"], [F.desc(F.abs("r")), F.col("feature")], 2).select("feature", "r", "rank"))


@query("q_S13_M30_contract", f"WITH {_PRED_SQL} SELECT count(*) AS n, count(DISTINCT doc_id) AS n_keys FROM p")
def contract(spark, sf_dir):
    """Inputs are there, keys are unique, probabilities are within (0, 1); then the counts."""
    from tidewater.sources import tables as T

    T.preflight(spark, sf_dir, {"documents": ["doc_id", "n_chars"], "labels": ["doc_id", "quality"]})
    p = _predictions(spark, sf_dir)
    T.require_unique(p, ["doc_id"])
    T.require_probabilities(p, ["m", "n", "q"])
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_keys"))


_JUDGED = """{r} AS ({raw}), {w}_d AS (SELECT label, feature, round(x - avg(x) OVER (PARTITION BY user_id, label, feature), 9) AS x, round(y - avg(y) OVER (PARTITION BY user_id, label, feature), 9) AS y FROM {l} WHERE x IS NOT NULL AND y IS NOT NULL),
{w} AS ({inner}), {out} AS (SELECT label, feature, raw, within, n FROM (SELECT label, feature, corr(rx, ry) AS raw, count(*) AS n FROM {r} GROUP BY ALL) JOIN (SELECT label, feature, corr(rx, ry) AS within FROM {w} GROUP BY ALL) USING (label, feature)
 WHERE raw IS NOT NULL AND abs(coalesce(within, 0)) >= 0.1 * abs(raw))"""


def _judged(long: str, out: str) -> str:
    return _JUDGED.format(l=long, out=out, r=f"{out}_r", w=f"{out}_w", raw=_ranked(f"(SELECT * FROM {long} WHERE x IS NOT NULL AND y IS NOT NULL)", "label, feature"), inner=_ranked(f"{out}_w_d", "label, feature"))


_PAIR_FEATURES = ("n", "k_mean", "h_mean", "v_max")


@query("q_M11_interaction_builder", f"""
WITH {SENSOR}, d AS (SELECT user_id, day, (avg(value) > 12)::INT AS y, (count(DISTINCT event_type) > 1)::INT AS mixed, count(*)::DOUBLE AS n, avg(k)::DOUBLE AS k_mean, avg(h)::DOUBLE AS h_mean, CASE WHEN max(h) % 4 > 0 THEN max(value) END AS v_max FROM s GROUP BY ALL),
t AS (SELECT * FROM d WHERE day <= DATE '2024-01-20'), f AS ({" UNION ALL ".join(f"SELECT user_id, day, '{c}' AS feature, {c} AS x FROM t" for c in _PAIR_FEATURES)}),
l AS (SELECT f.*, 'y' AS label, y FROM f JOIN t USING (user_id, day) UNION ALL SELECT f.*, 'mixed', mixed FROM f JOIN t USING (user_id, day)), {_judged('l', 'j')},
v AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY label ORDER BY abs(raw) DESC, feature) <= 3),
p AS (SELECT feature, row_number() OVER (ORDER BY count(*) DESC, max(abs(raw)) DESC, feature) AS place FROM v GROUP BY feature QUALIFY place <= 3),
m AS (SELECT feature, quantile_cont(x, 0.5) AS mid FROM f GROUP BY feature), g AS (SELECT user_id, day, feature, coalesce(x, mid) AS x FROM f JOIN m USING (feature)),
z AS (SELECT user_id, day, feature, place, (x - avg(x) OVER (PARTITION BY feature)) / stddev_pop(x) OVER (PARTITION BY feature) AS z FROM g JOIN p USING (feature)),
c AS (SELECT a.user_id, a.day, a.feature || '__x__' || b.feature AS feature, round(a.z * b.z, 9) AS x FROM z a JOIN z b ON a.user_id = b.user_id AND a.day = b.day AND a.place < b.place),
k AS (SELECT c.*, 'y' AS label, y FROM c JOIN t USING (user_id, day) UNION ALL SELECT c.*, 'mixed', mixed FROM c JOIN t USING (user_id, day)), {_judged('k', 'i')}
SELECT label, feature, round(raw, 6) AS raw, round(within, 6) AS within, n, row_number() OVER (PARTITION BY label ORDER BY abs(raw) DESC, feature) AS rank FROM i QUALIFY rank <= 2""")
def interaction_builder(spark, sf_dir):
    """Products of the features with most votes, the best two of each of two labels, from the training days."""
    days = sensor(spark, sf_dir).groupBy(*KEYS).agg(
        (F.avg("value") > 12).cast("int").alias("y"), (F.count_distinct("event_type") > 1).cast("int").alias("mixed"), F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("k").alias("k_mean"), F.avg("h").alias("h_mean"), F.when(F.max("h") % 4 > 0, F.max("value")).alias("v_max"),
    )
    train = written(days.filter(F.col("day") <= F.lit("2024-01-20").cast("date")))
    kept = Interactions(["y", "mixed"], "user_id", first=3, pool=3, best=2, least=0.0, rich=0.1).fit(train, _PAIR_FEATURES)
    return shown(kept.select("label", "feature", "raw", "within", "n", "rank"))


@query("q_M30_contract_report", f"""
WITH {_PRED_SQL}, o AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, count_if(o_orderdate IS NULL OR o_totalprice IS NULL) AS missing, count_if(o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL) AS status, count_if(NOT (o_totalprice BETWEEN 0 AND 100000) OR o_totalprice IS NULL) AS price FROM orders),
e AS (SELECT count(*) AS n, count(DISTINCT vec_id) AS keys, count_if(len(embedding) <> 64 OR embedding IS NULL OR list_bool_or(list_transform(embedding, lambda v: v IS NULL OR NOT isfinite(v)))) AS shape FROM embeddings),
q AS (SELECT count_if(NOT (m > 0 AND m < 1 AND n > 0 AND n < 1 AND q > 0 AND q < 1)) AS bad, count_if(y IS NULL) AS unlabelled FROM p),
r AS (SELECT 'orders' AS "table", 'columns' AS rule, 0 AS violations UNION ALL SELECT 'orders', 'rows in all', greatest(1 - n, 0) FROM o UNION ALL SELECT 'orders', 'unique o_orderkey', n - keys FROM o UNION ALL SELECT 'orders', 'known o_orderdate, o_totalprice', missing FROM o
 UNION ALL SELECT 'orders', 'one of o_orderstatus', status FROM o UNION ALL SELECT 'orders', 'between o_totalprice', price FROM o
 UNION ALL SELECT 'embeddings', 'columns', 0 UNION ALL SELECT 'embeddings', 'unique vec_id', n - keys FROM e UNION ALL SELECT 'embeddings', 'shape embedding', shape FROM e
 UNION ALL SELECT 'predictions', 'columns', 0 UNION ALL SELECT 'predictions', 'between m, n, q', bad FROM q UNION ALL SELECT 'predictions', 'known y', unlabelled FROM q)
SELECT "table", rule, violations::BIGINT AS violations, violations = 0 AS ok FROM r""")
def contract_report(spark, sf_dir):
    """Contracts of three tables as data, each checked by one aggregate: a row for each rule with its violations."""
    orders = C.Contract("orders", [C.Rows(1), C.Unique(["o_orderkey"]), C.Known(["o_orderdate", "o_totalprice"]), C.OneOf("o_orderstatus", ["F", "O"]), C.Between(["o_totalprice"], 0, 100_000)], ["o_orderkey", "o_orderdate"])
    vectors = C.Contract("embeddings", [C.Unique(["vec_id"]), C.Shape("embedding", 64)], ["vec_id", "embedding"])
    views = C.Contract("predictions", [C.Between(["m", "n", "q"], 0, 1, strict=True), C.Known(["y"])])
    found = [C.report(spark.read.parquet(f"{sf_dir}/{c.table}.parquet"), c) for c in (orders, vectors)]
    return found[0].unionByName(found[1]).unionByName(C.report(_predictions(spark, sf_dir), views))


#: Ordered rules: the first that holds gives the class.
_COLUMN_RULES = (
    ("suffix", "key", "key"), ("suffix", "date", "time"), ("prefix", "l_ship", "shipping"), ("suffix", "price", "money"), ("name", "l_discount", "money"), ("name", "l_tax", "money"), ("suffix", "priority", "rank"), ("suffix", "status", "flag"), ("suffix", "flag", "flag"),
)


@query("q_M27_U3_column_classes", """
WITH c AS (
  SELECT 'key' AS class, 3 AS columns, count(l_orderkey) + count(l_partkey) + count(l_suppkey) AS cells FROM lineitem UNION ALL SELECT 'time', 1, count(l_shipdate) FROM lineitem
  UNION ALL SELECT 'money', 3, count(l_extendedprice) + count(l_discount) + count(l_tax) FROM lineitem UNION ALL SELECT 'flag', 2, count(l_returnflag) + count(l_linestatus) FROM lineitem),
o AS (SELECT 'key' AS class, 2 AS other UNION ALL SELECT 'time', 1 UNION ALL SELECT 'money', 1 UNION ALL SELECT 'flag', 1)
SELECT class, columns::BIGINT AS columns, cells::BIGINT AS cells, other::BIGINT AS in_orders FROM c JOIN o USING (class)""")
def column_classes(spark, sf_dir):
    """Columns by ordered prefix and suffix rules: for the classes that both tables have, how many columns, and the values in those of one."""
    from tidewater.sources import catalogue as G

    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")}
    found = written(G.catalogue(spark, tables, _COLUMN_RULES))
    sizes = found.groupBy("class").pivot("table", list(tables)).count().dropna().filter("class <> 'unclassified'")
    names = {r["class"]: G.columns_of(found, "lineitem", [r["class"]]) for r in sizes.collect()}
    chosen = G.projected(tables["lineitem"], found, "lineitem", names)
    counts = F.array(*(F.struct(F.lit(c).alias("class"), sum((F.count(x) for x in xs), F.lit(0)).alias("cells")) for c, xs in sorted(names.items())))
    return shown(chosen.agg(counts.alias("s")).select(F.inline("s")).join(sizes, "class").select("class", F.col("lineitem").alias("columns"), "cells", F.col("orders").alias("in_orders")))
