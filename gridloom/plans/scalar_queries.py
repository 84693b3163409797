"""Scalar functions, normalisers, ranks and closed-form estimates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import scalar as sc
from gridloom.operators import ranks
from gridloom.plans.registry import query
from gridloom.sources.cells import GRID_SQL, band, cells, footprint, table

U8 = "u8 AS (SELECT cell_id, y, x, CAST((cell_id * 37) % 256 AS INTEGER) AS q, CAST((cell_id * 53) % 256 AS INTEGER) AS r FROM g)"


def _u8(spark, sf):
    return cells(spark, sf).select("cell_id", "y", "x", ((F.col("cell_id") * 37) % 256).cast("int").alias("q"), ((F.col("cell_id") * 53) % 256).cast("int").alias("r"))


def _r(df, *cols):
    return df.select("cell_id", *[F.round(c, 6).alias(c) for c in cols])


@query(f"WITH {GRID_SQL} SELECT cell_id, qty IS NOT NULL AND qty > -1e30 AS valid FROM g")
def e01_valid(spark, sf):
    return cells(spark, sf, items=True).select("cell_id", band(F.col("qty")).isNotNull().alias("valid"))


@query(f"WITH {GRID_SQL}, q AS (SELECT median(qty) AS m, greatest(quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25), 0.5 * stddev_pop(qty), 1e-6) AS i FROM g) SELECT cell_id, round(greatest(-8, least(8, (qty - m) / i)), 6) AS z FROM g, q WHERE qty IS NOT NULL")
def e03_robust_z_floor(spark, sf):
    return _r(sc.robust_z(cells(spark, sf, items=True).where("qty IS NOT NULL"), "qty", "z", floor_sd=0.5), "z")


@query(f"WITH {GRID_SQL}, q AS (SELECT median(qty) AS m, greatest(quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25), 1e-6) AS i FROM g) SELECT cell_id, CASE WHEN qty IS NULL THEN 0 ELSE round(1 / (1 + exp(-greatest(-10, least(10, (qty - m) / i)))), 6) END AS s FROM g, q")
def e04_robust_sigmoid(spark, sf):
    z = sc.robust_z(cells(spark, sf, items=True), "qty", "z", bound=10.0)
    return _r(z.withColumn("s", F.coalesce(sc.expit(F.col("z")), F.lit(0.0))), "s")


@query(f"WITH {GRID_SQL}, q AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM g) SELECT cell_id, round(greatest(0, least(1, (v - a) / (b - a))), 6) AS s FROM g, q")
def e06_norm01(spark, sf):
    return _r(sc.quantile01(cells(spark, sf), "v", "s", 0.02, 0.98), "s")


@query(f"WITH {GRID_SQL}, {U8} SELECT cell_id, round(CASE WHEN q > 0 THEN ((q - 1) / 254.0) * ((q - 1) / 254.0) * 12.5 END, 6) AS a, round(CASE WHEN q > 0 THEN ((q - 1) / 254.0) * 12.5 END, 6) AS b FROM u8")
def e07_decode(spark, sf):
    d = _u8(spark, sf)
    return _r(d.withColumn("a", sc.decode_u8(F.col("q"), 12.5, "sqrt")).withColumn("b", sc.decode_u8(F.col("q"), 12.5, "linear")), "a", "b")


@query(f"WITH {GRID_SQL}, {U8} SELECT cell_id, round(CASE WHEN q > 0 THEN (q / 255.0) * (q / 255.0) * 3.0 END, 6) AS a FROM u8")
def e08_dequantise_sqrt(spark, sf):
    t = F.col("q") / 255.0
    return _r(_u8(spark, sf).withColumn("a", F.when(F.col("q") > 0, t * t * 3.0)), "a")


@query(f"WITH {GRID_SQL}, {U8} SELECT cell_id, round((nullif(q, 0) - 1) / 254.0, 6) AS a FROM u8")
def e09_unpack(spark, sf):
    return _r(_u8(spark, sf).withColumn("a", (F.nullif(F.col("q"), F.lit(0)) - 1) / 254.0), "a")


@query(f"WITH {GRID_SQL}, {U8}, r AS (SELECT cell_id, greatest(1e-3, least(1 - 1e-3, q / 255.0)) AS r FROM u8) SELECT cell_id, round(ln(r / (1 - r)), 6) AS a FROM r")
def e10_rank_score(spark, sf):
    return _r(_u8(spark, sf).withColumn("a", sc.rank_logit(F.col("q"))), "a")


@query(f"WITH {GRID_SQL} SELECT cell_id, round(row_number() OVER (ORDER BY qty, cell_id) / (count(*) OVER ())::DOUBLE, 6) AS a FROM fp WHERE qty IS NOT NULL")
def e11_footprint_rank(spark, sf):
    r = ranks.numbered(footprint(spark, sf, items=True), "qty", "cell_id", "i", "n")
    return _r(r.withColumn("a", F.col("i") / F.col("n")), "a")


@query(f"WITH {GRID_SQL} SELECT cell_id, round((rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 - 1) / (count(*) OVER () - 1), 6) AS a FROM fp WHERE qty IS NOT NULL")
def e12_percentile_rank(spark, sf):
    r = ranks.placed(footprint(spark, sf, items=True), "qty")
    return _r(r.withColumn("a", (F.col("__below") + (F.col("__same") - 1) / 2) / (F.col("__all") - 1)), "a")


@query(f"WITH {GRID_SQL}, r AS (SELECT cell_id, qty, count(qty) OVER (ORDER BY qty RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, count(qty) OVER () AS n FROM g WHERE qty IS NOT NULL) SELECT g.cell_id, CAST(coalesce(floor((c - 1) * 65534.0 / (n - 1)), 0) AS INTEGER) AS a FROM g LEFT JOIN r USING (cell_id)")
def e13_rank_u16(spark, sf):
    g = cells(spark, sf, items=True)
    r = ranks.placed(g, "qty").select("cell_id", (F.col("__below") + F.col("__same")).alias("c"), F.col("__all").alias("n"))
    return g.select("cell_id").join(r, "cell_id", "left").select("cell_id", F.coalesce(F.floor((F.col("c") - 1) * 65534.0 / (F.col("n") - 1)), F.lit(0)).cast("int").alias("a"))


P2 = "p2 AS (SELECT cell_id, greatest(1e-6, least(1 - 1e-6, ((cell_id * 37) % 101) / 100.0)) AS a, greatest(1e-6, least(1 - 1e-6, ((cell_id * 61) % 101) / 100.0)) AS b FROM g)"


def _p2(spark, sf):
    return cells(spark, sf).select("cell_id", (((F.col("cell_id") * 37) % 101) / 100.0).alias("a"), (((F.col("cell_id") * 61) % 101) / 100.0).alias("b"))


@query(f"WITH {GRID_SQL}, {P2} SELECT cell_id, round(1 / (1 + exp(-(0.65 * ln(a / (1 - a)) + 0.35 * ln(b / (1 - b))))), 6) AS m FROM p2")
def e15_log_odds_blend(spark, sf):
    return _r(_p2(spark, sf).withColumn("m", sc.blend(F.col("a"), F.col("b"))), "m")


@query(f"WITH {GRID_SQL}, {P2} SELECT cell_id, round(1 / (1 + exp(-(ln(a / (1 - a)) + ln(0.01 / 0.99) - ln(0.25 / 0.75)))), 6) AS m FROM p2")
def e16_prior_shift(spark, sf):
    return _r(_p2(spark, sf).withColumn("m", sc.prior_shift(F.col("a"), 0.01, 0.25)), "m")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE greatest(0, least(1, (value - 40) / 20)) END AS s FROM events")
def e17_sanitise(spark, sf):
    raw = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise((F.col("value") - 40) / 20)
    return table(spark, sf, "events").select("event_id", sc.sanitise(raw).alias("s"))


@query("SELECT p_partkey, try_cast(nullif(regexp_extract(p_size || ' mm ' || p_brand, '^\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS a, try_cast(nullif(regexp_extract(p_brand, '^\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS b FROM part")
def e18_leading_number(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sc.leading_number(F.concat(F.col("p_size").cast("string"), F.lit(" mm "), F.col("p_brand"))).alias("a"), sc.leading_number(F.col("p_brand")).alias("b"))


@query(f"WITH {GRID_SQL} SELECT cell_id, round(ln(1 + qty), 6) AS qty_log, round(disc, 6) AS disc FROM g")
def e19_allowed_features(spark, sf):
    """Columns on the allow list, distances as log1p; others never leave."""
    allow = {"qty": F.log1p, "disc": lambda c: F.col(c)}
    g = cells(spark, sf, items=True)
    return g.select("cell_id", *[F.round(f(c), 6).alias("qty_log" if c == "qty" else c) for c, f in allow.items() if c in g.columns])


AFF = (2.0, 0.5, 10.0, -0.25, 3.0, -4.0)


@query(f"WITH {GRID_SQL} SELECT cell_id, y * 2.0 + x * 0.5 + 10.0 AS a, y * -0.25 + x * 3.0 - 4.0 AS b FROM g")
def e20_affine(spark, sf):
    a, b = sc.affine(F.col("y"), F.col("x"), AFF)
    return cells(spark, sf).select("cell_id", a.alias("a"), b.alias("b"))


@query(f"WITH {GRID_SQL} SELECT cell_id, round(y::DOUBLE, 6) + 0 AS a, round(x::DOUBLE, 6) + 0 AS b FROM g")
def e21_affine_inverse(spark, sf):
    u, v = sc.affine(F.col("y"), F.col("x"), AFF)
    a, b = sc.affine_inverse(F.col("u"), F.col("v"), AFF)
    return cells(spark, sf).select("cell_id", u.alias("u"), v.alias("v")).select("cell_id", (F.round(a, 6) + 0.0).alias("a"), (F.round(b, 6) + 0.0).alias("b"))


@query("""WITH p AS (SELECT user_id, event_id, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
n AS (SELECT *, greatest(1, ceil(abs(nx - x) / 20))::BIGINT AS n FROM p WHERE nx IS NOT NULL) SELECT user_id, event_id, k.k AS part, round(x + (nx - x) * k.k / n, 6) AS x FROM n, unnest(range(n)) k(k)""")
def e22_densify(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf, "events").withColumn("nx", F.lead("value").over(w)).where("nx IS NOT NULL")
    p = p.withColumn("n", F.greatest(F.lit(1), F.ceil(F.abs(F.col("nx") - F.col("value")) / 20)))
    p = p.select("user_id", "event_id", "value", "nx", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part"))
    return p.select("user_id", "event_id", "part", F.round(F.col("value") + (F.col("nx") - F.col("value")) * F.col("part") / F.col("n"), 6).alias("x"))


LN = "l AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS c, ((s_suppkey % 7) / 10.0)::DOUBLE AS m FROM supplier)"


@query(f"WITH {LN} SELECT a.k AS a, b.k AS b, round((a.m * b.c + a.c) / (1 - a.m * b.m), 4) AS y, round(b.m * ((a.m * b.c + a.c) / (1 - a.m * b.m)) + b.c, 4) AS x FROM l a JOIN l b ON b.k = a.k + 1")
def e23_intersection(spark, sf):
    """Where y = m x + c of one line meets x = m y + c of the next."""
    line = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 1000).alias("c"), ((F.col("s_suppkey") % 7) / 10.0).alias("m"))
    b = line.select((F.col("k") - 1).alias("k"), F.col("k").alias("b"), F.col("c").alias("d"), F.col("m").alias("n"))
    y = (F.col("m") * F.col("d") + F.col("c")) / (1 - F.col("m") * F.col("n"))
    return line.join(b, "k").select(F.col("k").alias("a"), "b", F.round(y, 4).alias("y"), F.round(F.col("n") * y + F.col("d"), 4).alias("x"))


@query(f"WITH {GRID_SQL}, q AS (SELECT cell_id, disc, greatest(-8, least(8, (qty - m) / i)) AS z FROM g, (SELECT median(qty) AS m, greatest(quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25), 1e-6) AS i FROM g)) SELECT cell_id, round(0.7 / (1 + exp(-z)) + 0.3 * disc, 6) AS s FROM q WHERE disc IS NOT NULL")
def e29_weighted_sigmoid(spark, sf):
    z = sc.robust_z(cells(spark, sf, items=True), "qty", "z").where("z IS NOT NULL")
    return _r(z.withColumn("s", 0.7 * sc.expit(F.col("z")) + 0.3 * F.col("disc")), "s")


@query(f"WITH {GRID_SQL} SELECT cell_id, round(qty, 6) AS qty FROM g")
def e33_subset_channels(spark, sf):
    g = cells(spark, sf, items=True)
    return g.select("cell_id", *[F.round(c, 6).alias(c) for c in g.columns if c.startswith("q")])


GRID100 = "FROM range(1, 100) r(i)"


@query(f"SELECT i, round((i / 100.0) * (0.2 * 3 + 0.8 * 2.5 + 1e-7) / (1 - (i / 100.0) * (1 - 0.2 * 0.05 - 0.8)), 6) AS credit {GRID100}")
def k49_implied_credit(spark, sf):
    return spark.range(1, 100).select(F.col("id").alias("i"), F.round(sc.implied_credit(F.col("id") / 100.0, F.lit(3.0), 2.5), 6).alias("credit"))


@query(f"SELECT i, round((i / 100.0) / ((i / 100.0) + 0.2 * (3 - 0.05 * (i / 100.0)) + 0.8 * (2.5 - i / 100.0) + 1e-7), 6) AS dti {GRID100}")
def k50_model_dti(spark, sf):
    return spark.range(1, 100).select(F.col("id").alias("i"), F.round(sc.model_dti(F.col("id") / 100.0, F.lit(3.0), 2.5), 6).alias("dti"))


@query(f"WITH c AS (SELECT i, (0.16) * (0.2 * 3 + 0.8 * 2.5 + 1e-7) / (1 - 0.16 * (1 - 0.2 * 0.05 - 0.8)) * i / 100.0 AS tp {GRID100}) SELECT i, round(tp / (tp + 0.2 * (3 * i / 100.0 - 0.05 * tp) + 0.8 * (2.5 - tp) + 1e-7), 6) AS dti FROM c")
def k51_extrapolate_variant(spark, sf):
    """Score of a variant that keeps i per cent of the dots and of the credit."""
    tp = sc.implied_credit(F.lit(0.16), F.lit(3.0), 2.5) * F.col("id") / 100.0
    return spark.range(1, 100).select(F.col("id").alias("i"), F.round(sc.model_dti(tp, 3 * F.col("id") / 100.0, 2.5), 6).alias("dti"))


@query("""WITH p AS (SELECT event_id, value / 2000000 AS p FROM events), s AS (SELECT event_id, p, (count(*) OVER () - row_number() OVER (ORDER BY p, event_id) + 1) * p AS s FROM p)
SELECT event_id, round(least(1, max(s) OVER (ORDER BY p, event_id ROWS UNBOUNDED PRECEDING)), 4) AS adjusted FROM s""")
def k03_holm_adjust(spark, sf):
    p = table(spark, sf, "events").select("event_id", (F.col("value") / 2000000).alias("p"))
    return sc.holm_adjusted(p, "p", "event_id", "a").select("event_id", F.round("a", 4).alias("adjusted"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM events GROUP BY 1")
def k47_mean_and_deviation(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.count("*").alias("n"))


@query(f"WITH {GRID_SQL}, s AS (SELECT median(qty) AS m, quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25) AS iqr, 'qty' AS c FROM g WHERE p <> '1-URGENT' UNION ALL SELECT median(v), quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 'v' FROM g WHERE p <> '1-URGENT') SELECT c, round(m, 6) AS mid, round(iqr, 6) AS iqr FROM s")
def k29_gate_scaler_fit(spark, sf):
    long = cells(spark, sf, items=True).where("p <> '1-URGENT'").unpivot([], ["qty", "v"], "c", "value")
    q = long.groupBy("c").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"))
    return q.select("c", F.round(F.col("q")[1], 6).alias("mid"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("iqr"))


GATES = "s AS (SELECT median(qty) AS mq, quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25) AS iq, median(v) AS mv, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iv FROM g WHERE p <> '1-URGENT'), z AS (SELECT cell_id, coalesce(1 / (1 + exp(-(qty - mq) / iq)), 0.5) AS a, coalesce(1 / (1 + exp(-(v - mv) / iv)), 0.5) AS b, disc FROM g, s)"


def _gates(spark, sf):
    g = cells(spark, sf, items=True)
    s = g.where("p <> '1-URGENT'").agg(F.percentile("qty", [0.25, 0.5, 0.75]).alias("q"), F.percentile("v", [0.25, 0.5, 0.75]).alias("w"))
    g = g.join(F.broadcast(s))
    sig = lambda c, q: F.coalesce(sc.expit((F.col(c) - F.col(q)[1]) / (F.col(q)[2] - F.col(q)[0])), F.lit(0.5))
    return g.withColumn("a", sig("qty", "q")).withColumn("b", sig("v", "w"))


@query(f"WITH {GRID_SQL}, {GATES} SELECT cell_id, round((a + b) / 2 * a, 6) AS s FROM z")
def k30_gate_product(spark, sf):
    return _r(_gates(spark, sf).withColumn("s", (F.col("a") + F.col("b")) / 2 * F.col("a")), "s")


@query(f"WITH {GRID_SQL}, {GATES} SELECT cell_id, round((0.6 * a + 0.4 * b) * (1 - 0.5 * coalesce(disc, 0)), 6) AS s FROM z")
def k32_weighted_gate(spark, sf):
    return _r(_gates(spark, sf).withColumn("s", (0.6 * F.col("a") + 0.4 * F.col("b")) * (1 - 0.5 * F.coalesce("disc", F.lit(0.0)))), "s")


@query(f"WITH {GRID_SQL}, {GATES} SELECT cell_id, round(greatest(a, b) * (a + b) / 2 * (1 - a), 6) AS s FROM z")
def k33_concealed_gate(spark, sf):
    return _r(_gates(spark, sf).withColumn("s", F.greatest("a", "b") * (F.col("a") + F.col("b")) / 2 * (1 - F.col("a"))), "s")


@query(f"WITH {GRID_SQL}, {GATES} SELECT cell_id, round(greatest(0.05, least(1, 4 * a * b)), 6) AS s FROM z")
def k35_clipped_gate(spark, sf):
    return _r(_gates(spark, sf).withColumn("s", sc.clip(4 * F.col("a") * F.col("b"), 0.05, 1.0)), "s")


@query(f"WITH {GRID_SQL}, s AS (SELECT median(qty) AS m, quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25) AS i FROM g WHERE p <> '1-URGENT') SELECT cell_id, round(greatest(-8, least(8, (coalesce(qty, m) - m) / i)), 6) AS z FROM g, s")
def k11_standardise_with_fitted(spark, sf):
    """Impute and scale by statistics of the training rows."""
    g = cells(spark, sf, items=True)
    s = g.where("p <> '1-URGENT'").agg(F.percentile("qty", [0.25, 0.5, 0.75]).alias("q"))
    g = g.join(F.broadcast(s))
    z = (F.coalesce("qty", F.col("q")[1]) - F.col("q")[1]) / (F.col("q")[2] - F.col("q")[0])
    return _r(g.withColumn("z", sc.clip(z, -8.0, 8.0)), "z")


@query(f"WITH {GRID_SQL}, l AS (SELECT y, x FROM fp WHERE cell_id % 5 = 2), t AS (SELECT y, x FROM fp WHERE p = '1-URGENT'), h AS (SELECT count(*) AS n, count(*) FILTER (t.y IS NOT NULL) AS hit FROM l LEFT JOIN t USING (y, x)) SELECT n, hit, round(hit / n, 6) AS tau FROM h")
def k48_lattice_density(spark, sf):
    fp = footprint(spark, sf)
    hit = fp.where("cell_id % 5 = 2")
    return hit.agg(F.count("*").alias("n"), F.count_if(F.col("p") == "1-URGENT").alias("hit")).withColumn("tau", F.round(F.col("hit") / F.col("n"), 6))


@query(f"""WITH {GRID_SQL}, pool AS (SELECT qty, row_number() OVER (ORDER BY cell_id) - 1 AS i, count(*) OVER () AS n FROM g WHERE qty IS NOT NULL), need AS (SELECT cell_id, CAST('0x' || substr(md5('3:' || cell_id), 1, 12) AS BIGINT) AS h FROM g WHERE qty IS NULL)
SELECT need.cell_id, pool.qty AS fill FROM need, (SELECT max(n) AS n FROM pool) m, pool WHERE pool.i = need.h % m.n""")
def k52_random_fill(spark, sf):
    """Undefined cells take a hashed pick of the defined ones."""
    g = cells(spark, sf, items=True)
    pool = ranks.numbered(g.where("qty IS NOT NULL"), "cell_id", "cell_id", "i").select(F.col("qty").alias("fill"), (F.col("i") - 1).alias("i"))
    n = g.where("qty IS NOT NULL").agg(F.count("*").alias("n"))
    need = g.where("qty IS NULL").select("cell_id", sc.hashed(F.lit(3), "cell_id").alias("h")).join(F.broadcast(n)).withColumn("i", F.col("h") % F.col("n"))
    return need.join(pool, "i").select("cell_id", "fill")
