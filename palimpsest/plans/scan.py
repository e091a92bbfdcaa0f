"""Whole scans: a trace to findings, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions import lexicon as X
from palimpsest.functions.text import is_blank
from palimpsest.operators.classify import classify, document_hidden_text, page_texts
from palimpsest.operators.detectors import Scan, evaluate, find, registered
from palimpsest.operators.score import score_findings, severity_counts, severity_order
from palimpsest.sources.traces import Trace, text_sources


def prepare(trace: Trace, max_pages: int | None = X.MAX_PAGES) -> Scan:
    """Classified spans, page texts and text sources of a trace, over the first pages of each document (None: all pages)."""
    cap = lambda df: df if max_pages is None else df.where(F.col("page") < max_pages)
    spans = classify(cap(trace.spans), cap(trace.page_info), trace.covers, trace.hidden_layers)
    pages = page_texts(spans)
    return Scan(trace, spans, pages, text_sources(trace, pages))


def scan(trace: Trace, max_pages: int | None = X.MAX_PAGES) -> DataFrame:
    """All findings of a trace."""
    return find(prepare(trace, max_pages))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with ``rank`` within their document: by severity, page, code, then detector and order of emission."""
    from pyspark.sql import Window as W

    order = (severity_order(F.col("severity")), F.coalesce("page", F.lit(0)), F.col("code"), F.col("detector_ord"), F.col("order"))
    return findings.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))


def detector_runs(findings: DataFrame) -> DataFrame:
    """(detector, detector_ord, hits) for all detectors, those without a finding too."""
    spark = findings.sparkSession
    names = spark.createDataFrame([(d.name, i) for i, d in enumerate(registered())], "detector string, detector_ord int")
    return names.join(findings.groupBy("detector").agg(F.count("*").alias("hits")), "detector", "left").select("detector", "detector_ord", F.coalesce("hits", F.lit(0)).alias("hits"))


def model_view(spans: DataFrame) -> DataFrame:
    """Runs in reading order as a model gets them: doc_id, page, place, text, hidden, reasons, size, bbox."""
    from pyspark.sql import Window as W

    order = (F.bround(F.coalesce("bbox.y0", F.lit(0.0)), 1), F.bround(F.coalesce("bbox.x0", F.lit(0.0)), 1), F.col("span_ord"))
    rows = spans.where(~is_blank(F.col("text"))).repartition("doc_id", "page").withColumn("place", F.row_number().over(W.partitionBy("doc_id", "page").orderBy(*order)))
    box = F.when(F.col("bbox").isNotNull(), F.transform(F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"), lambda v: F.round(v, 2)))
    return rows.select("doc_id", "page", "place", "text", F.col("is_hidden").alias("hidden"), F.transform("reasons", lambda r: r["text"]).alias("reasons"), F.round("size", 2).alias("size"), box.alias("bbox"))


def overlays(spans: DataFrame) -> DataFrame:
    """Boxes of hidden runs in per cent of their page."""
    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    rows = spans.where(F.col("is_hidden") & ~is_blank(F.col("text")) & F.col("bbox").isNotNull() & (w > 0) & (h > 0))
    low = lambda v, by: F.round(F.greatest(F.lit(0.0), v / by) * 100, 3)
    size = lambda v, by: F.round(F.least(F.lit(1.0), v / by) * 100, 3)
    return rows.select("doc_id", "page", "span_ord", low(F.col("bbox.x0") - F.col("box.x0"), w).alias("left"), low(F.col("bbox.y0") - F.col("box.y0"), h).alias("top"), size(F.col("bbox.x1") - F.col("bbox.x0"), w).alias("width"), size(F.col("bbox.y1") - F.col("bbox.y0"), h).alias("height"))


#: What is said of documents that can't be read, by status.
ERRORS = {"too_large": "The file is larger than the limit.", "empty": "The file is empty.", "encrypted": "The document is protected by a password.", "unreadable": "The file could not be opened."}


def _said(key: Column, words: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in words.items()))


def page_views(s: Scan) -> DataFrame:
    """(doc_id, pages): for each page of a document number, hidden_chars, total_chars, overlays and model_view, in order."""
    views = model_view(s.spans).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("place", "text", "hidden", "reasons", "size", "bbox"))).alias("model_view"))
    boxes = overlays(s.spans).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("span_ord", "left", "top", "width", "height"))).alias("overlays"))
    pages = s.pages.join(views, ["doc_id", "page"], "left").join(boxes, ["doc_id", "page"], "left")
    page = F.struct((F.col("page") + 1).alias("number"), "hidden_chars", F.col("chars").alias("total_chars"), "overlays", "model_view")
    return pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))


def reports(trace: Trace, views: bool = True, max_pages: int | None = X.MAX_PAGES) -> DataFrame:
    """One row for each document, unreadable ones too.

    filename, sha256, bytes, ok, error, score, verdict with label and blurb, counts of runs, characters and severities, hidden_text,
    metadata, findings, detectors with their hits, warnings (the extractor's, and one for each detector that failed), and with ``views`` the pages.
    What an unreadable document has none of is 0 or empty.
    """
    s = prepare(trace, max_pages)
    findings = evaluate(s)
    item = F.struct("rank", "code", "detector", "severity", "weight", "title", "detail", "technique", "evidence", "page", "bbox", "extra")
    # a rule that threw has no severity, so its row ranks behind all findings
    listed = ranked(findings).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(~F.col("failed"), item))).alias("findings"), F.sort_array(F.collect_set(F.when(F.col("failed"), F.struct("detector_ord", "detector")))).alias("failed"))
    # scores, counts and detectors' hits are taken from the list, so findings are made once
    each = listed.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.code", "f.severity", "f.weight", "f.detector")
    totals = s.pages.groupBy("doc_id").agg(F.count("*").alias("pages_scanned"), F.sum("n_runs").alias("runs"), F.sum("n_hidden_runs").alias("hidden_runs"), F.sum("chars").alias("chars"), F.sum("hidden_chars").alias("hidden_chars"))
    metadata = trace.metadata.where("key is not null and value <> ''").groupBy("doc_id", "key").agg(F.min("value").alias("value")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    out = trace.docs.select("doc_id", "filename", "sha256", "bytes", "page_count", F.coalesce("status", F.lit("ok")).alias("status"), "warnings")
    parts = [totals, score_findings(each).drop("findings"), severity_counts(each, "doc_id"), document_hidden_text(s.pages), metadata, listed]
    for part in parts + [page_views(s)] * views:
        out = out.join(part, "doc_id", "left")
    ok = F.col("status") == "ok"
    zero = ("pages_scanned", "runs", "hidden_runs", "chars", "hidden_chars", "score", "total", *X.SEVERITIES)
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumn("hidden_share", F.bround(F.coalesce(F.try_divide("hidden_chars", "chars"), F.lit(0.0)), 4))
    hits = lambda name: F.coalesce(F.size(F.filter("findings", lambda f: f["detector"] == name)), F.lit(0))
    runs = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(info).alias("info"), F.greatest(hits(n), F.lit(0)).alias("hits")) for n, info in ((d.name, d.info) for d in registered())))
    error = F.when(~ok, F.coalesce(_said(F.col("status"), ERRORS), F.concat(F.lit("The file could not be read: "), "status")))
    out = out.withColumn("ok", ok).withColumn("error", error).withColumn("verdict", F.when(~ok, "error").otherwise(F.coalesce("verdict", F.lit("clean"))))
    out = out.withColumn("label", _said(F.col("verdict"), {k: v for k, (v, _) in X.VERDICTS.items()})).withColumn("blurb", F.coalesce("error", _said(F.col("verdict"), {k: v for k, (_, v) in X.VERDICTS.items()})))
    failed = F.transform("failed", lambda d: F.concat(F.lit("Detector "), d["detector"], F.lit(" failed.")))
    out = out.withColumn("warnings", F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.coalesce(failed, F.array().cast("array<string>")))).drop("failed")
    return out.withColumn("detectors", F.when(ok, runs)).withColumn("hidden_text", F.coalesce("hidden_text", F.lit("")))


def report_json(report: DataFrame) -> DataFrame:
    """(doc_id, report): each report as JSON."""
    return report.select("doc_id", F.to_json(F.struct(*(c for c in report.columns))).alias("report"))


def report_text(spans: DataFrame) -> DataFrame:
    """(doc_id, text): pages with a heading, a run on each line, hidden ones marked."""
    lines = model_view(spans).withColumn("line", F.concat(F.when(F.col("hidden"), "  [HIDDEN] ").otherwise(" " * 11), "text"))
    pages = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
    pages = pages.withColumn("t", F.concat(F.lit("----- page "), (F.col("page") + 1).cast("string"), F.lit(" -----\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")))
    return pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "t"))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))
