"""What scans of large tables show and move: large sizes, and rows that don't go over the network more often or wider than a query needs."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import classify as C
from palimpsest.operators.glyphs import GLYPHS, spans_of_glyphs
from palimpsest.plans import queries as plans
from palimpsest.sources.traces import SCHEMAS, trace_of


def test_large_sizes_have_no_exponent(spark):
    sizes = [None, 3 << 20, 10_000_000 << 20, (10_000_000 << 20) + (1 << 18), (1 << 53) - (1 << 20)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(T.bytesize(F.col("n"))).collect()]
    assert got == [None, "3.0 MB", "10000000.0 MB", "10000000.2 MB", "8589934591.0 MB"]


def _runs(spark, rows):
    """Runs (doc_id, page, span_ord, seqno, x0, y0, x1, y1, layer) as spans of a trace."""
    schema = "doc_id string, page int, span_ord int, seqno int, x0 double, y0 double, x1 double, y1 double, layer string"
    return spark.createDataFrame(rows, schema).withColumns({"bbox": F.struct("x0", "y0", "x1", "y1"), "type": F.lit(0), "size": F.lit(11.0), "text": F.lit("word")})


def test_what_is_said_of_documents_pages_and_runs(spark):
    rng = random.Random(3)
    rows, covers = [], []
    # pages with no cover, with few, with as many as are told to runs, and with many; odd keys; a page that has no info, a document that has no layers off
    for doc, page, n in (("a", 0, 0), ("a", 1, 3), ("b", 0, C.FEW), ("b", 2, C.FEW + 1), ("c", 0, 60), ("d", None, 2), (None, 0, 2)):
        for i in range(12):
            x, y = rng.randint(0, 30), rng.randint(0, 30)
            rows.append((doc, page, None if i == 11 else i, rng.randint(0, 9), float(x), float(y), float(x + rng.randint(0, 4)), float(y + rng.randint(0, 4)), rng.choice([None, " x ", "y"])))
        for i in range(n):
            x, y = rng.randint(0, 30), rng.randint(0, 30)
            covers.append((doc, page, i, rng.randint(0, 9), (float(x), float(y), float(x + rng.randint(0, 20)), float(y + rng.randint(0, 20))), None, [0.5]))
    info = [("a", 0, (0.0, 0.0, 20.0, 20.0), 0.25), ("a", 1, (0.0, 0.0, 9.0, 9.0), 0.5), ("b", 0, None, None), ("c", 0, (0.0, 0.0, 5.0, 5.0), 1.0), (None, 0, (0.0, 0.0, 5.0, 5.0), 1.0), ("d", None, (0.0, 0.0, 5.0, 5.0), 1.0)]
    layers = [("a", "x"), ("a", ""), ("c", "y "), ("d", "x"), (None, "x")]
    trace = trace_of(
        spark, spans=_runs(spark, rows), page_info=spark.createDataFrame(info, SCHEMAS["page_info"]), covers=spark.createDataFrame(covers, SCHEMAS["covers"]),
        hidden_layers=spark.createDataFrame(layers, "doc_id string, name string"),
    )
    off = {(d, n.strip()) for d, n in layers if n and d is not None}
    said = {(d, p): (box, share) for d, p, box, share in info if d is not None and p is not None}
    expected, area = [], lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    for d, p, o, seqno, *box, layer in rows:
        both = lambda r: area((max(box[0], r[0]), max(box[1], r[1]), min(box[2], r[2]), min(box[3], r[3])))  # noqa: B023, E731
        over = [k for cd, cp, k, s, r, *_ in covers if None not in (d, p, o) and (cd, cp) == (d, p) and s > seqno and area(r) > 0 and area(box) > 0 and both(r) >= C.COVERED * area(box)]
        expected.append((d, p, o, *box, *(said.get((d, p)) or (None, None)), (d, (layer or "").strip()) in off, min(over, default=None)))
    got = C.classify(trace.spans, trace.page_info, trace.covers, trace.hidden_layers).select("doc_id", "page", "span_ord", "bbox.*", "box", "image_share", "layer_off", "cover.cover_ord")
    assert sorted(map(repr, (tuple(tuple(v) if isinstance(v, tuple) else v for v in r) for r in got.collect()))) == sorted(map(repr, expected))
    assert {p for *_, p in expected} != {None} and any(e[0] == "c" and e[-1] is not None for e in expected) and any(e[:2] == ("b", 0) and e[-1] is not None for e in expected)


def test_runs_are_moved_once(spark):
    """Of the nine queries over classified runs none deals out runs' text more than once before it is classified."""
    for name in ("severity_count", "finding_titles", "detector_runs", "reason_texts", "model_view", "finding_score", "report_text", "document_hidden_text", "page_text"):
        plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [doc_id" not in plan.split("Union", 1)[0], name
        assert plan.count("hashpartitioning(l_orderkey") == 2, name  # the other one is for pages of many covers, and is empty without any


def test_glyphs_are_moved_once(spark):
    plan = plans.queries()["glyph_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange ") <= 4  # ends of blocks, which block is behind them, glyphs, pieces of runs


def test_of_glyphs_that_repeat_all_blocks_see_the_same(spark):
    """Glyphs that repeat a key but not its place, also where blocks end: the greatest counts, whatever the blocks and the order of rows."""
    rng = random.Random(8)
    glyph = lambda page, i, x0: {"doc_id": "d", "page": page, "ord": i, "code": 97 + i % 26, "baseline": 0.0, "x0": x0, "y0": 0.0, "x1": x0 + 6, "y1": 10.0, "seqno": 0, "type": 0, "font": "f", "size": 10.0}
    rows = [glyph(page, i, float(i * 6 + far)) for page in (0, None) for i in range(40) if i % 17 for far in ([0, 100] if i % 4 == 3 else [0])]
    kept = {}
    for r in rows:
        kept[r["page"], r["ord"]] = max(kept.get((r["page"], r["ord"]), r), r, key=lambda g: g["x0"])
    expected, last = [], None
    for (page, i), r in sorted(kept.items(), key=lambda kv: (kv[0][0] is None, kv[0][1])):
        if last is None or last["page"] != page or r["x0"] - last["x1"] > 5 or r["x0"] < last["x0"]:
            expected.append([page, i, ""])
        expected[-1][2] += chr(r["code"])
        last = r
    for block in (1, 2, 4, 7, 1 << 16):
        rng.shuffle(rows)
        df = spark.createDataFrame([{c: r.get(c) for c in spark.createDataFrame([], GLYPHS).columns} for r in rows], GLYPHS)
        got = spans_of_glyphs(df, block=block).select("page", "span_ord", "text").collect()
        assert sorted(map(repr, (list(r) for r in got))) == sorted(map(repr, expected))


def test_runs_that_repeat_count_once(spark):
    rows = _runs(spark, [("a", 0, 1, 0, 0.0, 0.0, 1.0, 1.0, "x"), ("a", 0, 2, 0, 0.0, 0.0, 1.0, 1.0, None), ("b", 1, 1, 0, 0.0, 0.0, 1.0, 1.0, "x")])
    trace = trace_of(spark, spans=rows.unionByName(rows).unionByName(rows), hidden_layers=spark.createDataFrame([("a", "x")], "doc_id string, name string"))
    parts = (trace.spans, trace.page_info, trace.covers, trace.hidden_layers)
    found = lambda **more: sorted(tuple(r) for r in C.classify(*parts, **more).select("doc_id", "span_ord", "layer_off").collect())
    assert found(once=True) == [("a", 1, True), ("a", 2, False), ("b", 1, False)]
    assert found() == sorted(3 * found(once=True))
