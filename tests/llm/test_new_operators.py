"""Hard negatives, archives and collocations against plain versions, over ordinary and odd rows."""

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import hard_negatives, phrases, queries, warc

SF = "/root/testdata/sf0.001"
BIG = 1 << 63


# ---- hard negatives


def whole(x):
    return int(x) * 256 if abs(x) >= 2.0**52 else math.floor(256 * x)


def held(s):
    return min(max(s, -BIG), BIG - 1)


def mined(rows, k=5, n=5, every=100):
    """Every anchor's positives and negatives by scoring all rows."""
    good = []
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [whole(x) for x in v], list(v), i))
    anchors = {}
    for r in good:
        if r[0] % every == 0 and (r[0] not in anchors or (r[3], r[1]) < (anchors[r[0]][3], anchors[r[0]][1])):
            anchors[r[0]] = r
    out = []
    for a in anchors.values():
        scored = [(-held(sum(p * q for p, q in zip(a[2], r[2], strict=False))), r[0], r[1] == a[1]) for r in good if r[0] != a[0]]
        pos = sorted(x[:2] for x in scored if x[2])[:k]
        neg = sorted(x[:2] for x in scored if not x[2])
        for ps, pid in pos:
            window = [x for x in neg if 80 * -ps <= 100 * -x[0] <= 100 * -ps][:n]
            out += [(a[0], pid, j + 1, nid, -ps, -ns) for j, (ns, nid) in enumerate(window)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, "x", 1.0) for i, v, y in rows], "vec_id long, embedding array<double>, label int, v string, score double").repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(df, label=moved, **options).collect()))


def test_hard_negatives_random_and_copied(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=8).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(900)]
    same = rng.normal(size=8).tolist()
    rows += [(10_000 + i, same, i % 3) for i in range(400)]  # one vector, many rows
    want = mined(rows)
    assert len(want) > 100
    assert run(spark, rows) == want
    assert run(spark, rows, span=200, queries=3, cells=5, sample=20) == want


def test_hard_negatives_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(100 * i, rng.normal(size=4).tolist(), i % 2) for i in range(6)]
    rows += [(i, rng.normal(size=4).tolist(), i % 2) for i in range(1, 60)]
    rows += [(None, [1.0] * 4, 0), (61, None, 0), (62, [1.0, None, 1.0, 1.0], 0), (63, [float("nan")] * 4, 1), (64, [float("inf")] * 4, 1), (65, [1.0] * 4, None)]
    rows += [(66, [], 0), (67, [2.0], 1), (100, [0.5] * 4, 0), (68, [3.0] * 6, 1), (69, [3.0] * 6, 1), (69, [3.0] * 6, 1), (-70, [1.0, 2.0, 3.0, 4.0], 0)]
    assert run(spark, rows) == mined(rows)
    huge = rows + [(200, [1e30, -1e30, 3.0, 0.1], 1), (71, [1e40] * 4, 0), (72, [-1e300] * 4, 1)]
    assert run(spark, huge) == mined(huge)
    assert run(spark, [(0, [1.0], 0)]) == [] == run(spark, [(1, [1.0], 0)])


def test_hard_negatives_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.report(none).collect() == []


def test_bounds_hold_and_prune():
    """Bounds enclose every score, and leave few rows to score: a tenth of the supplied ones, which have no clusters."""
    con = duckdb.connect()
    got = con.sql("SELECT vec_id, embedding, label FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    v = np.floor(256 * np.array([r[1] for r in got], float))
    low, high = (np.array([int(x) for x in f(v, axis=0)], object) for f in (np.min, np.max))
    inner, least, most = hard_negatives.marks(v[:300], np.minimum(low, 0), np.maximum(high, 0), hard_negatives.CELLS)
    cells = hard_negatives.approximate(v, inner)
    ids, labels = np.array([r[0] for r in got]), np.array([r[2] for r in got], np.int64)
    at = ids % 100 == 0
    lo, up = hard_negatives.bounds(v[at], cells, least.astype(float), most.astype(float))
    exact = v @ v[at].T
    assert (lo <= exact).all() and (exact <= up).all()
    block = hard_negatives.Block(ids, labels, cells, v)
    pos = block.positives(ids[at], labels[at], v[at], least.astype(float), most.astype(float), 5)
    scores = [sorted((int(s) for a, _, s in pos if a == i), reverse=True) for i in range(at.sum())]
    assert all(len(s) == 5 for s in scores)
    block.negatives(labels[at], v[at], scores, least.astype(float), most.astype(float), (80, 100), 5)
    assert block.scored < 0.1 * block.asked


# ---- archives

ODD_PAGES = [
    (1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (9, None, "x" * 1500), (3, "http://b/é ü\r\nInjected: 1", "y" * 999), (4, "u", "y" * 999),
    (5, "", ""), (6, "u", None), (None, "n", "z" * 2000), (7, "n7", "z" * 2000), (None, "m", "w" * 2000), (None, "m", "w" * 2000),
    (8, "line", "\r\n\r\nWARC/1.1\r\n\r\n" * 200), (10, "e", "é" * 500), (11, "e", "é" * 500), (12, "e", "é" * 499), (13, "d", "q" * 1000), (13, "d", "q" * 1000), (14, "s", "\U0001f600" * 3000), (15, "long", "longer " * 400_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "k", 1, True) for r in ODD_PAGES], "page_id long, url string, html string, key string, digest int, revisit boolean").repartition(3)


def archived(rows):
    top = defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None and (top[h or ""] is None or i > top[h or ""]):
            top[h or ""] = i
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and i != top[h or ""]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None))
    return Counter(out)


def test_archives_report(pages):
    assert Counter(map(tuple, warc.report(pages).collect())) == archived(ODD_PAGES)


def test_archives_round_trip(spark, pages):
    """Small archives, spans and gaps; payloads and urls come back; each record is a gzip member that stands alone."""
    index = warc.write(pages, roll=600)
    rows = index.collect()
    assert len(rows) == len(ODD_PAGES) and len({r["file"] for r in rows}) > 3
    assert Counter(r["url"] for r in rows) == Counter(u or "" for _, u, _ in ODD_PAGES)
    for r in rows:
        fs, path = warc._open(r["file"])
        with fs.open_input_file(path) as f:
            f.seek(r["offset"])
            text = gzip.GzipFile(fileobj=io.BytesIO(f.read(r["length"]))).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"\r\nInjected:") == 0
    html = defaultdict(set)
    for i, _, h in ODD_PAGES:
        html[i].add((h or "").encode())
    for options in ({}, {"span": 700, "gap": 0}, {"gap": 10**9}):
        got = warc.read(index, **options).collect()
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == archived(ODD_PAGES)
        for r in got:
            assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) in html[r["page_id"]]
    one = warc.read(index.where("page_id = 8")).collect()
    assert len(one) == 1 and one[0]["payload_bytes"] == 3200


def test_archives_refuse_damage(spark, pages):
    index = warc.write(pages.where("page_id = 14"))
    r = index.first()
    with pytest.raises(Exception, match="digest|whole record|malformed|decompress|incorrect"):
        warc.read(index.withColumn("length", F.col("length") - 5)).collect()
    fs, path = warc._open(r["file"])
    with fs.open_input_file(path) as f:
        data = bytearray(f.read())
    text = gzip.decompress(bytes(data)).replace("\U0001f600".encode(), "\U0001f601".encode(), 1)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(gzip.compress(text))
    with pytest.raises(ValueError, match="malformed"):
        warc.parse(gzip.compress(text + b"more"))


def test_reads_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (20, 5), (100, 1)], gap=5) == [(0, 25), (100, 101)]
    assert warc.coalesced([(0, 10), (11, 5)], gap=0) == [(0, 10), (11, 16)] and warc.coalesced([]) == []


def test_archives_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.report(none).collect() == [] and warc.write(none).count() == 0


# ---- collocations


def collocated(rows, max_n=4, least=30, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, max_n + 1):
                for i in range(len(w) - size + 1):
                    f[lang or "und" if lang is None else lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        some = {k: a for k, a in c.items() if len(k) > 1 and a >= least}
        found = []
        for k, a in some.items():
            cuts = [((2_000_000 * a) // (c[k[:j]] + c[k[j:]]), j) for j in range(1, len(k))]
            score, j = min(cuts)
            inside = any(len(o) > len(k) and 100 * b >= 80 * a and any(o[i : i + len(k)] == k for i in range(len(o) - len(k) + 1)) for o, b in some.items())
            if not inside:
                found.append((-score, -a, " ".join(k).encode(), c[k[:j]], c[k[j:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def text_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "中文", "\x1c", "a\xa0b"]
    rows = []
    for i in range(400):
        words = [rng.choice(vocabulary[: 4 + i % 13]) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            words[5:5] = ["New", "york", "city", "hall"]
        gaps = [rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n", "?! "]) for _ in words]
        rows.append(("".join(w + g for w, g in zip(words, gaps, strict=True)), ["en", "de", None, "und", ""][i % 5]))
    rows += [(None, "en"), ("", None), (" \t ", "en"), (".,;", "xx"), ("same same " * 3000, "en"), ("one " * 65 + "two", "en"), ("x" * 50_000, "en")]
    rows += [("of the of the of the", "en")] * 20
    return rows


@pytest.mark.parametrize("max_n", [2, 4, 5])
def test_collocations(spark, monkeypatch, max_n):
    rows = text_rows()
    df = spark.createDataFrame([(i, t, x, "f", 1, 2) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f int, size int").repartition(4)
    want = collocated(rows, max_n, least=5)
    assert len(want) > 30
    assert sorted(map(tuple, phrases.collocations(df, max_n=max_n, least=5).collect())) == want
    monkeypatch.setattr(phrases, "SLOTS", 7)  # nearly every slot is shared
    for name, value in (("RUN", 3), ("BYTES", 300), ("CODED", 9), ("HELD", 1), ("PARTS", 4)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(map(tuple, phrases.collocations(df, max_n=max_n, least=5, top=3).collect())) == [r for r in want if r[1] <= 3]


def test_collocations_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).collect() == []


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_warc", "op13_phrases"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_stages_keep_columns_of_any_name(spark):
    """Columns with dots, backticks and spaces in their names pass every stage that returns whole rows."""
    import corpus_pipeline

    rows = [(i, f"line {i} of some plain words that say nothing much at all here mail a{i}@b.cd\nand more words {'xyzuvw'[i % 6] * 4} follow", "en", "s", 9, i, "q", 1.5) for i in range(12)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` string, `e f` double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert {(r["doc_id"], r["a.b"], r["c`d"], r["e f"]) for r in got.collect()} <= {(i, i, "q", 1.5) for i in range(12)}, name
