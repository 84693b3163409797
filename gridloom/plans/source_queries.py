"""Scans, sinks, lines and validation rules over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import lines as ln
from gridloom.operators import ranks, rules
from gridloom.plans.registry import query
from gridloom.plans.stencil_queries import DENSE
from gridloom.sources import scans
from gridloom.sources.cells import GRID_SQL, band, cells, footprint, inside, prediction, spec, table, truth
from gridloom.operators.stencil import dense


@query(f"WITH {GRID_SQL} SELECT cell_id, CASE WHEN abs(qty - 25) > 1e-9 THEN qty END AS b FROM g")
def a01_load_band(spark, sf):
    """One band; its nodata value becomes null."""
    return cells(spark, sf, items=True).select("cell_id", band(F.col("qty"), 25.0).alias("b"))


@query(f"WITH {GRID_SQL} SELECT cell_id FROM fp")
def a02_decode_runs(spark, sf):
    """The footprint packed to run lengths, a payload for each grid row, and decoded again."""
    fp = footprint(spark, sf)
    w = spec(spark, sf).width
    payloads = scans.packed_mask(fp.select(F.col("y").cast("string").alias("mask"), F.col("x").alias("cell_id")), w)
    got = scans.decode_runs(payloads, w)
    return got.select((F.col("mask").cast("long") * w + F.col("cell_id")).alias("cell_id"))


@query(f"WITH {GRID_SQL} SELECT y, x FROM fp")
def a03_load_footprint(spark, sf):
    return footprint(spark, sf).select("y", "x")


@query(f"WITH {GRID_SQL} SELECT cell_id, nullif((cell_id * 37) % 256, 0) AS b0, nullif((cell_id * 53) % 256, 0) AS b1 FROM fp")
def a04_read_u8_stack(spark, sf):
    """Bands of bytes, 0 to null, inside the footprint; dropped bands are never read."""
    keep = {"b0": 37, "b1": 53}
    return footprint(spark, sf).select("cell_id", *[F.nullif((F.col("cell_id") * k) % 256, F.lit(0)).alias(b) for b, k in keep.items()])


@query(f"WITH {GRID_SQL} SELECT g.cell_id, v, qty, disc FROM g SEMI JOIN (SELECT cell_id FROM fp WHERE p = '1-URGENT') s USING (cell_id)")
def a06_read_stack_rows(spark, sf):
    """Rows by id out of two aligned tables of columns."""
    g = cells(spark, sf, items=True)
    a, b = g.select("cell_id", "v"), g.select("cell_id", "qty", "disc")
    return a.join(b, "cell_id").join(truth(footprint(spark, sf)).select("cell_id"), "cell_id", "left_semi")


@query("SELECT 2 AS line_no, 'line,flight,x_coord,y_coord' AS names")
def a08_sniff_header(spark, sf):
    text = ["// survey", "// area 1", "LINE, Flight ,X coord,Y-coord", "100,1,5,6"]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, text string")
    return scans.header(lines, ["line", "flight"]).select("line_no", F.array_join("names", ",").alias("names"))


LINE = """s0 AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events),
s1 AS (SELECT *, CASE WHEN d IS NULL OR d > 40 THEN 1 ELSE 0 END AS nw FROM s0),
s2 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, CASE WHEN nw = 1 THEN 0.0 ELSE d END AS seg FROM s1),
s3 AS (SELECT *, sum(seg) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS dist FROM s2)"""
ORDER = ("ts", "event_id")


def _runs(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return ln.runs(e, "user_id", ORDER, "value", 40.0)


SUMMARY = "SELECT user_id, count(*) AS n, min(value) AS lo, max(value) AS hi, count(*) FILTER (value > 50) AS over, CAST(max(run) AS BIGINT) AS runs, round(sum(seg), 6) AS length, round(sum(value) / count(*), 6) AS mean, round(count(*) FILTER (value > 50) / count(*), 6) AS share_over FROM s2 GROUP BY user_id".replace("AS over", 'AS "over"')


@query(f"WITH {LINE} {SUMMARY}")
def a09_parse_stream(spark, sf):
    """Lines summed up in one pass; whatever the chunks, the same rows."""
    return ln.summary(_runs(spark, sf), "user_id", "value")


@query(f"WITH {LINE} SELECT event_id, CAST(run AS BIGINT) AS run, round(seg, 6) AS seg FROM s2")
def g02_runs_and_gaps(spark, sf):
    return _runs(spark, sf).select("event_id", "run", F.round("seg", 6).alias("seg"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL")
def g03_partial_aggregates(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(f"WITH {LINE}, b AS (SELECT *, floor(round(dist, 6) / 25) AS bin FROM s3), l AS (SELECT *, lag(bin) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS pb FROM b) SELECT event_id, CAST(bin AS BIGINT) AS bin FROM l WHERE pb IS NULL OR pb <> bin")
def g04_thin_by_distance(spark, sf):
    return ln.thinned(ln.travelled(_runs(spark, sf), "user_id", ORDER), "user_id", ORDER, 25.0).select("event_id", "bin")


@query("SELECT event_type, round(sum(value) / nullif(count(*) FILTER (value > 99), 0), 4) AS per_peak FROM events GROUP BY 1")
def g05_ratio_of_sums(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.nullif(F.count_if(F.col("value") > 99), F.lit(0)), 4).alias("per_peak"))


@query("""WITH p AS (SELECT user_id, value AS y, (event_id % 100)::DOUBLE AS x, ts, event_id, lag(value) OVER w AS py, lag(event_id % 100) OVER w AS px FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT user_id, sum(sqrt((y - py) * (y - py) + (x - px) * (x - px))) AS len, arg_min((y, x), (ts, event_id)) AS a, arg_max((y, x), (ts, event_id)) AS b, min(y) AS ylo, max(y) AS yhi FROM p GROUP BY 1)
SELECT user_id, round(len, 4) AS length, ylo, yhi, round(CASE WHEN h < 0 THEN h + 180 WHEN h >= 180 THEN h - 180 ELSE h END, 4) AS heading FROM (SELECT *, degrees(atan2(b[1] - a[1], b[2] - a[2])) AS h FROM e)""")
def g06_line_stats(spark, sf):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    p = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").alias("y"), (F.col("event_id") % 100).cast("double").alias("x"))
    dy, dx = F.col("y") - F.lag("y").over(w), F.col("x") - F.lag("x").over(w)
    p = p.withColumn("seg", F.sqrt(dy * dy + dx * dx))
    key = F.struct(*ORDER)
    e = p.groupBy("user_id").agg(F.sum("seg").alias("len"), F.min_by(F.struct("y", "x"), key).alias("a"), F.max_by(F.struct("y", "x"), key).alias("b"), F.min("y").alias("ylo"), F.max("y").alias("yhi"))
    return e.select("user_id", F.round("len", 4).alias("length"), "ylo", "yhi", F.round(ln.heading(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x")), 4).alias("heading"))


@query("SELECT event_id, try_cast(nullif(CASE WHEN event_type = 'error' THEN 'NULL' WHEN event_type = 'signup' THEN '' ELSE CAST(user_id AS VARCHAR) END, '') AS DOUBLE) AS v, coalesce(try_cast(nullif(CASE WHEN event_type = 'error' THEN 'NULL' WHEN event_type = 'signup' THEN '' ELSE CAST(user_id AS VARCHAR) END, '') AS DOUBLE), 20.0) AS filled FROM events")
def a14_read_points(spark, sf):
    """Points whose text says NULL or nothing take the default."""
    raw = F.when(F.col("event_type") == "error", "NULL").when(F.col("event_type") == "signup", "").otherwise(F.col("user_id").cast("string"))
    v = F.nullif(raw, F.lit("")).try_cast("double")
    return table(spark, sf, "events").select("event_id", v.alias("v"), F.coalesce(v, F.lit(20.0)).alias("filled"))


@query("""WITH m AS (SELECT item_id, md5(text) AS sha, text FROM benchmark WHERE NOT contains(text, 'z')),
f AS (SELECT item_id, CASE WHEN length(text) % 3 = 0 THEN md5(text || '.') ELSE md5(text) END AS sha FROM benchmark WHERE length(text) % 5 <> 0),
d AS (SELECT * FROM f UNION ALL SELECT item_id, md5(text) FROM benchmark WHERE length(text) % 7 = 0),
n AS (SELECT item_id, count(*) AS n, max(sha) AS got FROM d GROUP BY 1)
SELECT * FROM (SELECT item_id, CASE WHEN n.n IS NULL THEN 'missing' WHEN m.item_id IS NULL THEN 'extra' WHEN n.n > 1 THEN 'duplicate' WHEN got <> sha THEN 'mismatch' END AS state FROM m FULL JOIN n USING (item_id)) WHERE state IS NOT NULL""")
def a15_manifest_complete(spark, sf):
    """A manifest against a store with lost, damaged, doubled and unlisted contents."""
    b = table(spark, sf, "benchmark")
    sha, n = F.md5(F.col("text").cast("binary")), F.length("text")
    damaged = F.md5(F.concat("text", F.lit(".")).cast("binary"))
    found = b.where(n % 5 != 0).select("item_id", F.when(n % 3 == 0, damaged).otherwise(sha).alias("sha")).unionByName(b.where(n % 7 == 0).select("item_id", sha.alias("sha")))
    return rules.manifest_gaps(b.where(~F.contains("text", F.lit("z"))).select("item_id", sha.alias("sha")), found, "item_id", "sha")


@query("""WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS n FROM pages)
SELECT page_id, i.i::INTEGER AS place, h[i.i] AS href, n[i.i] AS name FROM m, unnest(range(1, len(h) + 1)) i(i)""")
def a17_parse_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.posexplode(scans.links(F.col("html"))).alias("place", "l"))
    return p.select("page_id", (F.col("place") + 1).alias("place"), "l.href", "l.name")


POLY = [("a", [(5, 5), (5, 90), (80, 60), (60, 10)]), ("b", [(20, 20), (100, 30), (90, 110), (30, 100)])]
EDGES = [(k, *map(float, p), *map(float, q)) for k, ring in POLY for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
EDGE_SQL = "e AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b}, {c}, {d})" for k, a, b, c, d in EDGES) + ") t(poly, ay, ax, by_, bx)), pin AS (SELECT cell_id, poly FROM g, e WHERE (ay > y) <> (by_ > y) AND x < ax + (y - ay) * (bx - ax) / (by_ - ay) GROUP BY ALL HAVING count(*) % 2 = 1)"


def _inside(spark, sf):
    return scans.crossings(cells(spark, sf).select("cell_id", "y", "x"), spark.createDataFrame(EDGES, "poly string, ay double, ax double, by double, bx double"))


@query(f"WITH {GRID_SQL}, {EDGE_SQL} SELECT cell_id, poly FROM pin")
def a18_outline(spark, sf):
    return _inside(spark, sf)


@query("SELECT poly, round(sum(ax * by_ - bx * ay) / 2, 6) AS area FROM (VALUES " + ", ".join(f"('{k}', {a}, {b}, {c}, {d})" for k, a, b, c, d in EDGES) + ") t(poly, ay, ax, by_, bx) GROUP BY poly")
def a20_ring_area(spark, sf):
    """Signed area of a ring: its sign tells shells from holes."""
    e = spark.createDataFrame(EDGES, "poly string, ay double, ax double, by double, bx double")
    return e.groupBy("poly").agg(F.round(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2, 6).alias("area"))


@query(f"WITH {GRID_SQL}, {EDGE_SQL} SELECT g.cell_id, coalesce(min(CASE WHEN poly = 'a' THEN 1 WHEN poly = 'b' THEN 2 END), 0) AS area FROM g LEFT JOIN pin USING (cell_id) GROUP BY 1")
def a21_priority_areas(spark, sf):
    """Overlaps go to the first area; 0 is outside both."""
    hit = _inside(spark, sf).groupBy("cell_id").agg(F.min(F.when(F.col("poly") == "a", 1).otherwise(2)).alias("area"))
    return cells(spark, sf).select("cell_id").join(hit, "cell_id", "left").select("cell_id", F.coalesce("area", F.lit(0)).alias("area"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) > 50")
def a22_recorded_points(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k > 50")


@query("SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)(/[^?]*)?', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)(/[^?]*)?', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)(/[^?]*)?', 3) AS path FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)(/[^?]*)?')")
def a24_parse_source(spark, sf):
    pat = r"^(https?)://([^/]+)(/[^?]*)?"
    return table(spark, sf, "pages").where(F.col("url").rlike(pat)).select("page_id", *[F.regexp_extract("url", pat, i).alias(n) for i, n in enumerate(("scheme", "host", "path"), 1)])


@query(f"WITH {DENSE} SELECT y, x, CASE WHEN (2*y-w+1)*(2*y-w+1) + (2*x-w+1)*(2*x-w+1) <= (w-3)*(w-3) THEN coalesce(v, 0) ELSE 0 END AS v FROM dn")
def b01_write_grid_zero_outside(spark, sf):
    w = spec(spark, sf).width
    return dense(cells(spark, sf), w, w).select("y", "x", F.when(inside(w), F.coalesce("v", F.lit(0.0))).otherwise(0.0).alias("v"))


@query(f"WITH {DENSE} SELECT y, x, CASE WHEN (2*y-w+1)*(2*y-w+1) + (2*x-w+1)*(2*x-w+1) <= (w-3)*(w-3) THEN 0.5 END AS v FROM dn")
def b05_write_template(spark, sf):
    w = spec(spark, sf).width
    return dense(cells(spark, sf), w, w).select("y", "x", F.when(inside(w), 0.5).alias("v"))


@query(f"WITH {GRID_SQL}, r AS (SELECT cell_id, percent_rank() OVER (ORDER BY v) AS a FROM fp), q AS (SELECT cell_id, percent_rank() OVER (ORDER BY qty) AS b FROM fp WHERE qty IS NOT NULL) SELECT cell_id, CAST(floor(a * 65534) AS INTEGER) AS a, CAST(coalesce(floor(b * 65534), 0) AS INTEGER) AS b FROM r LEFT JOIN q USING (cell_id)")
def b06_rank_stack(spark, sf):
    fp = footprint(spark, sf, items=True)
    a, b = (ranks.percent_rank(fp, c, "r").select("cell_id", F.floor(F.col("r") * 65534).cast("int").alias(n)) for c, n in (("v", "a"), ("qty", "b")))
    return a.join(b, "cell_id", "left").select("cell_id", "a", F.coalesce("b", F.lit(0)).alias("b"))


@query("""WITH a AS (SELECT n_nationkey, n_regionkey, n_name FROM nation), b AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey = 3 THEN lower(n_name) ELSE n_name END AS n_name FROM a WHERE n_regionkey <> 4 UNION ALL SELECT * FROM a WHERE n_regionkey = 2),
l AS (SELECT n_regionkey AS part, count(*) AS lost FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1), e AS (SELECT n_regionkey AS part, count(*) AS added FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY 1)
SELECT r_regionkey AS part, coalesce(lost, 0) AS lost, coalesce(added, 0) AS added, coalesce(lost, 0) + coalesce(added, 0) = 0 AS reusable FROM region LEFT JOIN l ON l.part = r_regionkey LEFT JOIN e ON e.part = r_regionkey""")
def b08_verify_cached(spark, sf):
    """A cached copy against its source, part by part: reuse only what is equal both ways, repeats counted."""
    a = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name")
    region = F.col("n_regionkey")
    copy = a.where(region != 4).withColumn("n_name", F.when(region == 3, F.lower("n_name")).otherwise(F.col("n_name"))).unionByName(a.where(region == 2))
    return rules.cache_state(a, copy, "n_regionkey", table(spark, sf, "region").select(F.col("r_regionkey").alias("part")))


@query(f"WITH {DENSE} SELECT y, x, CASE WHEN (2*y-w+1)*(2*y-w+1) + (2*x-w+1)*(2*x-w+1) <= (w-3)*(w-3) THEN qty END AS v FROM dn")
def b09_null_exterior(spark, sf):
    w = spec(spark, sf).width
    return dense(cells(spark, sf, items=True), w, w).select("y", "x", F.when(inside(w), F.col("qty")).alias("v"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ') ' || p_type || '!'), '[^0-9a-z]+', '-', 'g'), '-') AS slug FROM part")
def b10_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scans.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type", F.lit("!"))).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE substring(text, 1, 69) || '...' || right(text, 68) END AS note FROM documents")
def b11_note(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scans.note(F.col("text")).alias("note"))


@query("SELECT c_custkey, coalesce(round(o.last, 2), round(c_acctbal, 2)) AS last, coalesce(o.n, 0) + 1 AS history FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS last, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def b12_upsert(spark, sf):
    """Append each customer's orders to their history; the last one wins."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("l"), F.count("*").alias("n"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", F.round(F.coalesce("l", "c_acctbal"), 2).alias("last"), (F.coalesce("n", F.lit(0)) + 1).alias("history"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def m01_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


BLOCKS = "b AS (SELECT cell_id // 4096 AS b, sha256(string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY cell_id)) AS h FROM {t} GROUP BY 1)"


@query(f"WITH {GRID_SQL}, {BLOCKS.format(t='fp')} SELECT sha256(string_agg(h, ',' ORDER BY b)) AS sha FROM b")
def m02_footprint_hash(spark, sf):
    """The hash of the mask in its canonical text form, by blocks."""
    return rules.content_id(footprint(spark, sf), "cell_id", "sha")


@query(f"WITH {GRID_SQL}, d AS (SELECT cell_id FROM fp WHERE p = '2-HIGH' AND st = 'O'), {BLOCKS.format(t='d')} SELECT substring(sha256(string_agg(h, ',' ORDER BY b)), 1, 12) AS id FROM b")
def m03_scored_content_id(spark, sf):
    d = rules.content_id(prediction(footprint(spark, sf)), "cell_id", "id")
    return d.select(F.substring("id", 1, 12).alias("id"))


@query()
def m04_blob_sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.blob_sha(F.col("text")).alias("sha"))


PATHS = "p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN substring(path, 2) WHEN 1 THEN path WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN 'a\\b' ELSE 'x/y' || page_id END AS path FROM (SELECT page_id, regexp_extract(url, 'https?://[^/]+(/[^?]*)?', 1) AS path FROM pages))"


@query(f"WITH {PATHS} SELECT page_id, NOT regexp_matches(path, '^/|^$|\\\\|(^|/)\\.\\.(/|$)') AS safe FROM p")
def m05_safe_relative(spark, sf):
    path = F.regexp_extract("url", "https?://[^/]+(/[^?]*)?", 1)
    k = F.col("page_id") % 5
    made = F.when(k == 0, F.substr(path, F.lit(2))).when(k == 1, path).when(k == 2, F.concat(F.lit("a/../"), "page_id")).when(k == 3, F.lit("a\\b")).otherwise(F.concat(F.lit("x/y"), "page_id"))
    return table(spark, sf, "pages").select("page_id", rules.safe_relative(made).alias("safe"))


@query("SELECT doc_id, length(h) = 32 AND regexp_matches(h, '^[0-9a-f]{32}$') AS ok FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN upper(md5(text)) ELSE md5(text) END AS h FROM documents)")
def m06_hash_shape(spark, sf):
    h = F.md5(F.col("text").cast("binary"))
    return table(spark, sf, "documents").select("doc_id", rules.is_hash(F.when(F.col("lang") == "de", F.upper(h)).otherwise(h), 32).alias("ok"))


CHECKS = "c AS (SELECT 'no_nulls' AS name, TRUE AS hard, count(*) FILTER (v IS NULL) = 0 AS passed FROM fp UNION ALL SELECT 'positive', TRUE, count(*) FILTER (v <= 0) = 0 FROM fp UNION ALL SELECT 'unique', TRUE, count(DISTINCT cell_id) = count(*) FROM fp UNION ALL SELECT 'qty_known', FALSE, count(*) FILTER (qty IS NULL) = 0 FROM fp UNION ALL SELECT 'in_range', TRUE, max(v) <= 400000 FROM fp)"


def _checks(spark, sf):
    v = F.col("v")
    return rules.check_rows(footprint(spark, sf, items=True), {
        "no_nulls": (F.count_if(v.isNull()) == 0, True), "positive": (F.count_if(v <= 0) == 0, True),
        "unique": (F.count_distinct("cell_id") == F.count("*"), True), "qty_known": (F.count_if(F.col("qty").isNull()) == 0, False), "in_range": (F.max(v) <= 400000, True),
    })


@query(f"WITH {GRID_SQL}, {CHECKS} SELECT * FROM c")
def m07_check_variants(spark, sf):
    return _checks(spark, sf)


@query(f"WITH {GRID_SQL}, {CHECKS} SELECT bool_and(passed OR NOT hard) AS passed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT passed), '') AS failed FROM c")
def m08_preflight(spark, sf):
    return rules.verdict(_checks(spark, sf))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) > 2000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'lang' END, CASE WHEN toxic IS NULL OR toxic <> 0 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS blockers FROM documents LEFT JOIN labels USING (doc_id)")
def m09_evidence_blockers(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.select("doc_id", F.array_join(rules.blockers(long=F.length("text") <= 2000, lang=F.col("lang") == "en", toxic=F.col("toxic") == 0), ",").alias("blockers"))


@query("SELECT doc_id, length(trim(text)) BETWEEN 1 AND 140 AS ok FROM documents")
def m10_note_evidence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.length(F.trim("text")).between(1, 140), F.lit(False)).alias("ok"))


@query(f"WITH {GRID_SQL}, {CHECKS} SELECT printf('%d of %d checks pass', count(*) FILTER (passed), count(*)) AS status FROM c")
def m11_concise_status(spark, sf):
    return _checks(spark, sf).agg(F.format_string("%d of %d checks pass", F.count_if("passed"), F.count("*")).alias("status"))


@query(f"WITH {GRID_SQL}, {CHECKS}, a AS (SELECT name, passed FROM c UNION ALL SELECT 'owner_review', FALSE UNION ALL SELECT 'external_holdout', FALSE) SELECT bool_and(passed) AS positive, count(*) FILTER (NOT passed) AS blocking FROM a")
def m12_selector(spark, sf):
    """Two gates stay closed whatever the rest says, so the decision is never positive."""
    closed = spark.sql("SELECT * FROM VALUES ('owner_review', false), ('external_holdout', false) AS t(name, passed)")
    return _checks(spark, sf).select("name", "passed").unionByName(closed).agg(F.bool_and("passed").alias("positive"), F.count_if(~F.col("passed")).alias("blocking"))


@query("SELECT user_id, bool_and(value BETWEEN 0 AND 900) AND count(*) >= 10 AND count(DISTINCT event_type) = 5 AS passed FROM events GROUP BY 1")
def m13_recorded_evidence(spark, sf):
    """Nested evidence: every entry in range, enough of them, of all kinds."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_type", "value")).alias("e"))
    ok = F.forall("e", lambda x: x["value"].between(0, 900)) & (F.size("e") >= 10) & (F.size(F.array_distinct(F.transform("e", lambda x: x["event_type"]))) == 5)
    return e.select("user_id", ok.alias("passed"))


@query("SELECT user_id, len(list_filter(['click', 'view', 'purchase'], lambda x: NOT list_contains(seen, x))) = 0 AS complete FROM (SELECT user_id, list(event_type) AS seen FROM events GROUP BY 1)")
def m14_required_subset(spark, sf):
    seen = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    need = F.array(*[F.lit(x) for x in ("click", "view", "purchase")])
    return seen.select("user_id", (F.size(F.array_except(need, "seen")) == 0).alias("complete"))


@query("WITH a AS (SELECT p_brand AS name, max(p_size) > 45 AS ok FROM part GROUP BY 1), b AS (SELECT p_brand AS name, max(p_size) > 49 AS ok FROM part GROUP BY 1) SELECT bool_and(coalesce(a.ok IS NOT DISTINCT FROM b.ok OR (a.ok AND NOT coalesce(b.ok, TRUE) AND name IN ('Brand#1', 'Brand#2', 'Brand#3')), FALSE)) AS compatible FROM a FULL JOIN b USING (name)")
def m15_gates_compatible(spark, sf):
    part = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias("s"))
    return rules.only_listed_drops(part.select("name", (F.col("s") > 45).alias("ok")), part.select("name", (F.col("s") > 49).alias("ok")), ["Brand#1", "Brand#2", "Brand#3"])


@query("SELECT event_id, event_type <> 'error' AND event_type <> 'view' AND CAST(props->>'$.k' AS BIGINT) BETWEEN 0 AND 60 AS ok FROM events")
def m16_strict_number(spark, sf):
    """A number, not a boolean and not a text, in range."""
    j = F.when(F.col("event_type") == "error", '{"k": true}').when(F.col("event_type") == "view", '{"k": "7"}').otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", rules.number_in(j, "$.k", 0, 60).alias("ok"))


@query("SELECT l_orderkey, l_linenumber, l_discount > 0 AND l_discount <= l_tax + 0.05 AND l_tax + 0.05 <= 1 AS ok FROM lineitem")
def m17_positive_interval(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rules.positive_interval(F.col("l_discount"), F.col("l_tax") + 0.05).alias("ok"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'accept' WHEN quality = 0 AND toxic = 1 THEN 'reject' ELSE 'hold' END AS decision FROM labels")
def m19_tri_state(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf, "labels").select("doc_id", F.when((q == 1) & (t == 0), "accept").when((q == 0) & (t == 1), "reject").otherwise("hold").alias("decision"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AND d.n_chars = length(d.text) AS consistent FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def m20_receipt(spark, sf):
    """What the row says of its content against the content."""
    label = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has"))
    d = table(spark, sf, "documents").join(label, "doc_id", "left")
    return d.select("doc_id", (F.coalesce("has", F.lit(False)) & (F.col("n_chars") == F.length("text"))).alias("consistent"))


@query("WITH s AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS u FROM lineitem GROUP BY 1) SELECT count(*) FILTER (s.k IS NULL) AS missing, count(*) FILTER (n <> u) AS duplicated FROM orders LEFT JOIN s ON s.k = o_orderkey")
def m25_validate_snapshot(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("u"))
    return table(spark, sf, "orders").join(s, "o_orderkey", "left").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") != F.col("u")).alias("duplicated"))


@query("WITH m AS (SELECT o_orderkey, o_totalprice AS said FROM orders), r AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS got FROM lineitem GROUP BY 1) SELECT count(*) AS rows, count(*) FILTER (got IS NULL) AS absent, count(*) FILTER (abs(got - said) > 1) AS differ FROM m LEFT JOIN r USING (o_orderkey)".replace("AS rows", 'AS "rows"'))
def m30_recompute_audit(spark, sf):
    """Recorded totals against recomputed ones."""
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("got"))
    d = table(spark, sf, "orders").join(r, "o_orderkey", "left")
    return d.agg(F.count("*").alias("rows"), F.count_if(F.col("got").isNull()).alias("absent"), F.count_if(F.abs(F.col("got") - F.col("o_totalprice")) > 1).alias("differ"))


@query("SELECT 'customer' AS site, c_custkey AS id, c_acctbal AS measure, c_mktsegment AS tag FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def m31_source_measurement(spark, sf):
    """Each source through its own explicit adapter to one row shape."""
    c = table(spark, sf, "customer").select(F.lit("customer").alias("site"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("measure"), F.col("c_mktsegment").alias("tag"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("site"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("measure"))
    return c.unionByName(s, allowMissingColumns=True)
