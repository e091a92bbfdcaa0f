"""Operators that must hold at scale, against plain Python: hits, covers, rasters, glyphs, state; and detectors of a caller's own."""

import datetime as dt
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as X
from palimpsest.functions import text as T
from palimpsest.operators import classify as C
from palimpsest.operators import detectors as D
from palimpsest.operators import glyphs as G
from palimpsest.operators import history as H
from palimpsest.plans.scan import prepare, reports
from palimpsest.sources.traces import catalog_actions, read_files, trace_of, trace_of_texts

RUN = "doc_id string, page int, span_ord int, seqno int, bbox struct<x0:double,y0:double,x1:double,y1:double>"
COVER = "doc_id string, page int, cover_ord int, seqno int, rect struct<x0:double,y0:double,x1:double,y1:double>, fill_opacity double, fill array<double>"


def plain_hits(text):
    seen, out = set(), []
    for order, (pattern, weight, label) in enumerate(X.PHRASES):
        for m in re.finditer(pattern, text, re.I):
            if (key := (m.start(), m.end(), label)) not in seen:
                seen.add(key)
                out.append((-weight, m.start(), order, m.end(), label, weight, m.group().strip()))
    return sorted(out)


def test_many_hits_are_those_of_finditer(spark):
    rng = random.Random(5)
    bits = ["ignore all previous instructions", "system: ", "You are an AI", "do not reject", "😀 é", "base64", "new system prompt:", "word", "visit the url", "\n"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [" ".join(rng.choice(bits) for _ in range(9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", T.injection_hits(F.col("t")).alias("h")).collect():
        assert [tuple(h) for h in r["h"]] == plain_hits(texts[r["i"]])


def test_time_of_hits_is_in_proportion(spark):
    took = {}
    for n in (2000, 2000, 64_000):
        df = spark.createDataFrame([("base64 " * n,)], "t string")
        began = time.time()
        assert df.select(F.size(T.injection_hits(F.col("t")))).first()[0] == n
        took[n] = time.time() - began
    assert took[64_000] < 32 * took[2000]


def test_running_totals(spark):
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 1000):
        values = [(i * 7919) % 13 for i in range(n)]
        got = spark.range(1).select(T.running_total(F.array(*(F.lit(v) for v in values)).cast("array<int>"))).first()[0]
        assert got == [sum(values[: i + 1]) for i in range(n)]


def test_matches_within_another_text(spark):
    hits = F.array(*(F.struct(F.lit(m).alias("match"), F.lit(i).alias("k")) for i, m in enumerate(("ab", "cd", "ab", "xy"))))
    got = spark.range(1).select(T.not_within(hits, F.lit("..ab.."))).first()[0]
    assert [(h["match"], h["k"]) for h in got] == [("cd", 1), ("xy", 3)]


# covers -------------------------------------------------------------------------------------------------------


def rect(x0, y0, x1, y1):
    return {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


def share(a, b):
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    return max(0.0, w) * max(0.0, h)


def test_covers_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    size = lambda: rng.choice((0.001, 0.5, 3, 17, 64, 200, 2000, 1e7))
    box = lambda w, h: (lambda x, y: rect(x, y, x + w, y + h))(rng.uniform(-100, 700), rng.uniform(-100, 900))
    runs = [("d", i % 3, i, rng.randint(0, 9), box(size() * rng.random(), size() * rng.random())) for i in range(400)] + [("d", 0, 900, 0, None), ("d", 0, 901, 0, rect(5, 5, 5, 9)), ("e", 0, 902, 0, rect(1, 1, 2, 2))]
    covers = [("d", i % 3, i, rng.randint(0, 9), box(size(), size()), rng.choice((None, 0.5, 1.0)), rng.choice(([1.0], None))) for i in range(300)]
    covers += [("d", 0, 1000, 9, rect(float("-inf"), -1e300, float("inf"), 1e300), 1.0, [0.0]), ("d", 1, 1001, 9, rect(0, 0, 128, 64), None, [0.0])]
    runs += [("d", 1, 910, 1, rect(0, 0, 128, 64)), ("d", 1, 911, 1, rect(64, 32, 128, 64)), ("d", 2, 912, 1, rect(0, 0, 1, 1))]
    expected = {}
    for d, p, ord_, seq, b in runs:
        own = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) if b else 0
        for cd, cp, cord, cseq, r, opacity, fill in covers:
            hides = fill is not None and (opacity or 1.0) >= 0.95
            if b and own > 0 and hides and (d, p) == (cd, cp) and cseq > seq and share(b, r) >= 0.92 * own:
                expected.setdefault((d, p, ord_), cord)
    found = C.covered(spark.createDataFrame(runs, RUN), spark.createDataFrame(covers, COVER))
    assert {(r["doc_id"], r["page"], r["span_ord"]): r["cover"]["cover_ord"] for r in found.collect()} == expected and len(expected) > 20


def test_pairs_that_are_tested_grow_with_overlaps(spark):
    """A page of n by n runs, each with a cover of its own: cells give each run few covers, however many the page has."""
    for n in (10, 40):
        at = [(i, j) for i in range(n) for j in range(n)]
        runs = spark.createDataFrame([("d", 0, k, 0, rect(10 * i, 10 * j, 10 * i + 8, 10 * j + 8)) for k, (i, j) in enumerate(at)], RUN)
        covers = spark.createDataFrame([("d", 0, k, 1, rect(10 * i, 10 * j, 10 * i + 8, 10 * j + 8), None, [0.0]) for k, (i, j) in enumerate(at)], COVER)
        cells = C.cover_cells(covers)
        assert cells.count() <= 4 * len(at)
        pairs = C.run_cells(runs, cells).join(cells, ["doc_id", "page", "lx", "ly", "cx", "cy"]).count()
        assert pairs <= 9 * len(at) and C.covered(runs, covers).count() == len(at)


# rasters ------------------------------------------------------------------------------------------------------


def test_packed_rasters_stand_for_their_pixels(spark):
    rng = random.Random(3)
    pixels = [("d", p, x, y, *(rng.choice((0.0, 1.0)),) * 3) for p in range(2) for y in range(12) for x in range(40) if rng.random() < 0.95]
    df = spark.createDataFrame(pixels, "doc_id string, page int, x int, y int, r double, g double, b double")
    lines = C.packed(df).collect()
    out = {(r["page"], x, r["y"]): k["r"] for r in lines for k in r["runs"] for x in range(k["x"], k["x"] + k["n"])}
    assert out == {(p, x, y): r for _, p, x, y, r, _, _ in pixels} and all(r["runs"] == sorted(r["runs"]) for r in lines)
    assert sum(len(r["runs"]) for r in lines) < len(pixels)
    assert C.packed(df.unionByName(df)).count() == len(lines) and C.packed(df.limit(0)).count() == 0


def test_backgrounds_of_packed_and_plain_rasters_are_those_of_their_pixels(spark):
    rng = random.Random(4)
    w, h = 90, 61
    colour = {(x, y): rng.choice((0.0, 0.25, 0.5)) if x % 7 < 3 else 0.75 for x in range(w) for y in range(h)}
    df = spark.createDataFrame([("d", 0, x, y, c, c, c) for (x, y), c in colour.items()], "doc_id string, page int, x int, y int, r double, g double, b double")
    boxes = [rect(x, y, x + rng.uniform(0, 60), y + rng.uniform(0, 40)) for x, y in ((rng.uniform(-5, 95), rng.uniform(-5, 66)) for _ in range(60))] + [None]
    runs = spark.createDataFrame([("d", 0, i, 0, b) for i, b in enumerate(boxes)], RUN).withColumn("bg", F.lit(None).cast("struct<r:double,g:double,b:double>"))
    info = spark.createDataFrame([("d", 0, rect(0, 0, w, h))], f"doc_id string, page int, box {C.RASTER and 'struct<x0:double,y0:double,x1:double,y1:double>'}")

    def most(points):
        count, first = Counter(), {}
        for k, (x, y) in enumerate(points):
            count[colour[x, y]] += 1
            first.setdefault(colour[x, y], k)
        return max(count, key=lambda c: (count[c], -first[c])) if count else None

    page = most([(x, y) for y in range(0, h, max(1, h // 40)) for x in range(0, w, max(1, w // 40))])
    expected = []
    for b in boxes:
        points = []
        if b:
            x0, y0, x1, y1 = max(0, int(b["x0"]) - 2), max(0, int(b["y0"]) - 2), min(w, int(b["x1"]) + 2), min(h, int(b["y1"]) + 2)
            if x1 > x0 and y1 > y0:
                points = [(x, y) for y in range(y0, y1, max(1, (y1 - y0) // 12)) for x in range(x0, x1, max(1, (x1 - x0) // 24))]
        expected.append(most(points) if points else page)
    for raster in (df, C.packed(df)):
        assert [r["bg"]["r"] for r in C.backgrounds(runs, info, raster).orderBy("span_ord").collect()] == expected


# glyphs -------------------------------------------------------------------------------------------------------


def glyph(ord_, code, **more):
    row = {"doc_id": "d", "page": 0, "ord": ord_, "code": code, "baseline": 10.0, "x0": 6.0 * ord_, "y0": 0.0, "x1": 6.0 * ord_ + 6, "y1": 10.0, "seqno": 1, "type": 0, "font": "f", "size": 10.0, "ascender": 0.8, "descender": -0.2, "opacity": None, "color": [0.0], "colorspace": 1, "layer": None}
    return row | more


def test_glyphs_become_runs(spark):
    rng, rows, expected, x = random.Random(6), [], [], 0.0
    for i in range(700):
        style = {"font": "g"} if rng.random() < 0.05 else {}
        x += 6.0 + (7.0 if rng.random() < 0.05 else 0.0)
        rows.append(glyph(i * 3, rng.choice([ord("a"), ord("é"), 0x1F600, 0x6E2C, 32]), baseline=10.0 * (i // 200), x0=x, x1=x + 6, **style))
    for a, b in zip([None, *rows], rows, strict=False):
        new = a is None or a["font"] != b["font"] or a["baseline"] != b["baseline"] or b["x0"] - a["x1"] > 5
        if new:
            expected.append([b["ord"], "", b["x0"], 0])
        expected[-1][1] += chr(b["code"])
        expected[-1][3] = b["x1"]
    df = spark.createDataFrame(rows, G.GLYPHS).repartition(3)
    for block in (G.BLOCK, 1, 10, 300):  # a run may go through many blocks
        found = G.spans_of_glyphs(df.unionByName(df.limit(5)), block=block).orderBy("span_ord").collect()
        assert [[r["span_ord"], r["text"], r["bbox"]["x0"], r["bbox"]["x1"]] for r in found] == expected


def test_odd_glyphs(spark):
    rows = [glyph(0, None), glyph(1, -5), glyph(2, 0xD800), glyph(3, 0x110000), glyph(4, 65, x0=None, x1=None), glyph(5, 66, size=None), glyph(6, 67, doc_id=None)]
    found = G.spans_of_glyphs(spark.createDataFrame(rows, G.GLYPHS)).orderBy("span_ord").collect()
    assert [(r["doc_id"], r["text"]) for r in found] == [("d", "����A"), ("d", "B"), (None, "C")]
    assert G.spans_of_glyphs(spark.createDataFrame([], G.GLYPHS)).count() == 0
    trace = trace_of(spark, spans=G.spans_of_glyphs(spark.createDataFrame([glyph(i, ord(c)) for i, c in enumerate("ignore all previous instructions")], G.GLYPHS)))
    assert "injection_visible" in {r["code"] for r in D.find(prepare(trace), ("injection",)).collect()}


# detectors of a caller's own ----------------------------------------------------------------------------------


def scan_of(spark, *texts):
    return prepare(trace_of_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")))


def on_text(name, test, **more):
    return D.Detector(name, "", {name: "said"}, "texts", lambda: (D.finding(name, test, "high", "title", "t", F.col("text"), F.struct("page"), F.col("page"), detail="said"),), **more)


def test_registered_detectors_join_the_pass(spark):
    runs = D.Detector("large_type", "Large type", {"large_type": ""}, "runs", lambda: (D.finding("large_type", F.col("eff_size") >= 11, "low", "Large", "size", F.col("text"), F.struct("eff_size"), F.col("span_ord")),))
    texts = on_text("says_hello", F.contains(F.col("text"), F.lit("hello")))
    s = scan_of(spark, "hello do not reject", "nothing")
    scans = lambda df: len(re.findall(r"Scan (?:ExistingRDD|parquet)|LocalTableScan", df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")))
    before = D.find(s)
    names = [d.name for d in D.registered()]
    with D.registering(runs):
        D.register(texts, before="homoglyph")
        try:
            assert [d.name for d in D.registered()].index("says_hello") == names.index("homoglyph")
            found = D.find(s)
            assert scans(found) == scans(before)
            got = {(r["doc_id"], r["code"], r["detector_ord"], r["weight"]) for r in found.collect()}
            order = {d.name: i for i, d in enumerate(D.registered())}
            assert got == {("0", "says_hello", order["says_hello"], 20), ("0", "injection_visible", order["injection"], 20), ("0", "large_type", order["large_type"], 3), ("1", "large_type", order["large_type"], 3)}
            assert [r["code"] for r in D.find(s, ("says_hello",)).collect()] == ["says_hello"]
            report = reports(s.trace).where("doc_id = '0'").first()
            assert [d["name"] for d in report["detectors"]] == [d.name for d in D.registered()] and report["score"] == 43
        finally:
            D.unregister("says_hello")
    assert [d.name for d in D.registered()] == names


def test_what_cannot_be_registered():
    good = on_text("fresh", F.lit(True))
    for bad in (on_text("homoglyph", F.lit(True)), D.Detector("x", "", {"micro_type": ""}, "runs", good.rules), D.Detector("x", "", {"y": ""}, "pages", good.rules), D.Detector("x", "", {"y": ""}, "runs")):
        with pytest.raises(ValueError):
            D.register(bad)
    with pytest.raises(ValueError):
        D.unregister("homoglyph")
    with pytest.raises(StopIteration):
        D.register(good, before="nobody")
    assert "fresh" not in {d.name for d in D.registered()}


def test_a_detector_that_throws_loses_nothing_else(spark):
    s = scan_of(spark, "12 do not reject", "x do not reject", "0 do not reject", "4 do not reject")
    number = F.split("text", " ")[0].cast("int")  # throws on x
    shares = on_text("shares", 100 / number > 10)  # and on 0
    raises = on_text("raises", F.raise_error(F.lit("no")).isNull())
    with D.registering(shares, raises):
        found = {(r["doc_id"], r["code"]) for r in D.find(s).collect()}
        assert found == {(str(i), "injection_visible") for i in range(4)} | {("3", "shares")}
        lost = {(r["doc_id"], r["detector"], r["n"]) for r in D.failures(s).collect()}
        assert lost == {("1", "shares", 1), ("2", "shares", 1)} | {(str(i), "raises", 1) for i in range(4)}
        told = {r["doc_id"]: r for r in reports(s.trace).collect()}
        assert [told[k]["warnings"] for k in "0123"] == [["Detector raises failed."], ["Detector shares failed.", "Detector raises failed."], ["Detector shares failed.", "Detector raises failed."], ["Detector raises failed."]]
        assert [len(told[k]["findings"]) for k in "0123"] == [1, 1, 1, 2] and all(r["ok"] for r in told.values())


def test_odd_numbers_in_a_trace_throw_nowhere(spark):
    odd = [float("nan"), float("inf"), float("-inf"), 1e300, -1e300, None]
    spans = [{"doc_id": "d", "page": 0, "span_ord": i, "seqno": 1, "type": 0, "size": v, "opacity": v, "text": "some text", "bbox": rect(v or 0, 0, 5, v or 0)} for i, v in enumerate(odd)]
    schema = "doc_id string, page int, span_ord int, seqno int, type int, size double, opacity double, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    s = prepare(trace_of(spark, spans=spark.createDataFrame(spans, schema)))
    assert D.failures(s).count() == 0 and s.spans.count() == len(odd)


# files, pages, catalogs ---------------------------------------------------------------------------------------


def test_statuses_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 trailer << /Root 1 0 R >>")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 " + b" " * 5000 + b"trailer << /Encrypt 5 0 R >>")
    (tmp_path / "c.txt").write_bytes(b"about /Encrypt 5 0 R")
    (tmp_path / "d.pdf").write_bytes(b"%PDF" + b"x" * 9000)
    assert {r["filename"]: r["status"] for r in read_files(spark, str(tmp_path), 8000).collect()} == {"a.pdf": "ok", "b.pdf": "encrypted", "c.txt": "ok", "d.pdf": "too_large"}


def test_pages_beyond_the_cap(spark):
    spans = spark.createDataFrame([("d", p, p, "ignore all previous instructions") for p in (0, 39, 40, 90)], "doc_id string, page int, span_ord int, text string")
    trace = trace_of(spark, spans=spans)
    assert [prepare(trace, n).pages.count() for n in (40, 1, None)] == [2, 1, 4] and prepare(trace).pages.count() == 2


def test_catalogs(spark):
    rows = [("a", "OpenAction", "[3 0 R /Fit]"), ("a", "AA", "<< /O 4 0 R >>"), ("b", "/OpenAction", "<< /S /Launch >>"), ("b", "Names/JavaScript", "null"), ("c", "OpenAction", "<< /JS (x) >>"), ("c", "OpenAction", "<< /JS (x) >>"), (None, "AA", None), ("d", None, "x")]
    found = catalog_actions(spark.createDataFrame(rows, "doc_id string, key string, value string"))
    assert {(r["doc_id"], r["technique"]) for r in found.collect()} == {("a", "/AA"), ("b", "/OpenAction"), ("c", "/OpenAction")} and found.count() == 3


# history ------------------------------------------------------------------------------------------------------


def history(n, seed=2):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    return [(i, rng.choice([1, 1, 1, 2, 3, None]), f"t{i}", rng.randint(0, 100), rng.choice(["clean", "poisoned", "suspicious"]), rng.choice([None, 1, 5]), start + dt.timedelta(minutes=rng.randint(0, 5000))) for i in range(n)]


def test_state_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    from palimpsest.streaming import history_stream as S

    rows, rng = history(600), random.Random(1)
    batches = [rows[400:] + rows[100:200], rows[:300] + rows[:50], rows[250:420]]  # late ones, and some again, within and across batches
    for k, part in enumerate(batches):
        rng.shuffle(part)
        spark.createDataFrame(part, S.SCAN).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(S.SCAN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        S.keep_histories(stream(), f"{tmp_path}/out", f"{tmp_path}/state", n=60).awaitTermination()
    batch = spark.createDataFrame(rows, S.SCAN)
    got = S.histories(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, got.drop("newest").collect())) == sorted(map(tuple, H.user_stats(batch).collect()))
    newest = {}
    for r in sorted(rows, key=lambda r: (r[6], r[0]), reverse=True):
        if r[1] is not None:
            newest.setdefault(r[1], []).append(r[0])
    assert {r["user_id"]: r["newest"] for r in got.collect()} == {u: ids[:60] for u, ids in newest.items()}


def test_saving_trims_only_who_is_touched(spark):
    schema = "id long, user_id long, created_at timestamp"
    of = lambda rows: spark.createDataFrame([(i, u, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i, u in rows], schema)
    old, new = of([(i, 1 + i % 2) for i in range(10)] + [(90, None)]), of([(20, 1), (21, None)])
    got = sorted((r["user_id"] or 0, r["id"]) for r in H.save(old, new, 3).collect())
    assert got == [(0, 21), (0, 90), (1, 6), (1, 8), (1, 20), *((2, i) for i in (1, 3, 5, 7, 9))]


def test_the_limit_of_a_user_is_applied_where_rows_are_read(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("user_id"), F.col("id").alias("created_at"))
    plan = H.retain(df, 60)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and H.retain(df, 60).count() == 180
