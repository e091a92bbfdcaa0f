"""Traces: the relations that a scan reads, and where they come from.

A trace says what a document draws and carries. An extractor for a file format fills the tables; here
they are read from Parquet, and documents that are plain text become traces of one page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
SCHEMAS = {
    "docs": "doc_id string, filename string, sha256 string, bytes long, page_count int, status string, xmp string, warnings array<string>",
    "page_info": f"doc_id string, page int, box {RECT}, image_share double",
    "spans": f"doc_id string, page int, span_ord int, seqno int, type int, font string, size double, ascender double, descender double, opacity double, color array<double>, colorspace int, layer string, bbox {RECT}, text string, bg struct<r:double,g:double,b:double>",
    "covers": f"doc_id string, page int, cover_ord int, seqno int, rect {RECT}, fill_opacity double, fill array<double>",
    "annots": "doc_id string, page int, type string, content string, title string, subject string, flags int, bbox array<double>",
    "widgets": "doc_id string, page int, name string, value string, tooltip string, field_flags int, bbox array<double>",
    "metadata": "doc_id string, key string, value string",
    "attachments": "doc_id string, name string, size long, desc string",
    "actions": "doc_id string, title string, technique string, evidence string",
    "hidden_layers": "doc_id string, name string",
}


@dataclass
class Trace:
    """The tables of a trace; each may hold any number of documents."""

    docs: DataFrame
    page_info: DataFrame
    spans: DataFrame
    covers: DataFrame
    annots: DataFrame
    widgets: DataFrame
    metadata: DataFrame
    attachments: DataFrame
    actions: DataFrame
    hidden_layers: DataFrame


def trace_of(spark: SparkSession, **tables: DataFrame) -> Trace:
    """A trace of these tables; columns that a table lacks are null, tables that are missing empty."""
    def fit(name: str) -> DataFrame:
        empty = spark.createDataFrame([], SCHEMAS[name])
        if name not in tables:
            return empty
        have = tables[name]
        return have.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema))

    return Trace(**{name: fit(name) for name in SCHEMAS})


def read_traces(spark: SparkSession, folder: str) -> Trace:
    """The trace tables below a folder, as Parquet."""
    return Trace(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in SCHEMAS.items()})


def read_files(spark: SparkSession, paths: str, max_bytes: int = 20 << 20) -> DataFrame:
    """Files as rows: doc_id and sha256 (of the content), filename, bytes, status (too_large, empty, encrypted or ok), content.

    encrypted: a PDF whose last 4096 bytes name an encryption dictionary, as its trailer does. Text that merely looks so doesn't count: only PDFs are asked.
    """
    files = spark.read.format("binaryFile").load(paths)
    tail = F.decode(F.substring("content", -4096, 4096), "ISO-8859-1")
    pdf = F.startswith("content", F.lit(b"%PDF-"))
    status = F.when(F.col("length") > max_bytes, "too_large").when(F.col("length") == 0, "empty").when(pdf & tail.rlike(r"/Encrypt\s+\d+\s+\d+\s+R"), "encrypted").otherwise("ok")
    sha = F.sha2("content", 256)
    return files.select(sha.alias("doc_id"), sha.alias("sha256"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"), status.alias("status"), "content")


def trace_of_texts(texts: DataFrame) -> Trace:
    """Rows (doc_id, text) as documents of one page with one ordinary run."""
    spark = texts.sparkSession
    rows = texts.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    docs = rows.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.lit(1).alias("page_count"), F.lit("ok").alias("status"))
    spans = rows.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("span_ord"), F.lit(0).alias("seqno"), F.lit(0).alias("type"), F.lit(11.0).alias("size"), "text")
    return trace_of(spark, docs=docs, spans=spans, page_info=rows.select("doc_id", F.lit(0).alias("page"), F.lit(0.0).alias("image_share")))


def opaque(covers: DataFrame) -> DataFrame:
    """The covers that hide what they are drawn over: filled, not empty, opacity 0.95 or more (none and 0 count as 1)."""
    solid = F.coalesce(F.nullif(F.col("fill_opacity"), F.lit(0.0)), F.lit(1.0)) >= 0.95
    return covers.where(F.col("fill").isNotNull() & solid & (F.col("rect.x1") > F.col("rect.x0")) & (F.col("rect.y1") > F.col("rect.y0")))


def image_share(images: DataFrame) -> DataFrame:
    """(doc_id, page, image_share) of rows (doc_id, page, page_area, image_area): 1 at most, and where the page has no area."""
    share = F.when(F.coalesce(F.max("page_area"), F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.sum(F.abs("image_area")) / F.max("page_area")))
    return images.groupBy("doc_id", "page").agg(share.alias("image_share"))


def catalog_actions(catalog: DataFrame) -> DataFrame:
    """Actions from rows (doc_id, key, value) of documents' catalogs: OpenAction where it runs a script or launches something, Names/JavaScript, AA.

    Keys may have a slash before them; null, empty and ``null`` values are none. A key that repeats is an action for each distinct value.
    """
    key, value = F.regexp_replace("key", "^/", ""), F.trim("value")
    runs = F.lower(value).rlike("javascript|/js|/launch")
    kinds = (
        ("OpenAction", runs, "The document does something when it is opened", "/OpenAction"),
        ("Names/JavaScript", F.lit(True), "The document has scripts of its own", "/Names /JavaScript"),
        ("AA", F.lit(True), "The document reacts to events", "/AA"),
    )
    action = F.coalesce(*(F.when((key == k) & test, F.struct(F.lit(title).alias("title"), F.lit(technique).alias("technique"))) for k, test, title, technique in kinds))
    rows = catalog.where(F.col("value").isNotNull() & ~value.isin("", "null")).select("doc_id", action.alias("a"), F.col("value").alias("evidence")).where("a is not null").distinct()
    return rows.select("doc_id", "a.title", "a.technique", "evidence")


def script_actions(actions: DataFrame, script_objects: DataFrame) -> DataFrame:
    """The actions, and for documents without a JavaScript action one for their script objects (doc_id, n)."""
    has = actions.where(F.col("technique").endswith("JavaScript")).select("doc_id").distinct()
    objects = script_objects.where("n > 0").join(has, "doc_id", "left_anti")
    return actions.unionByName(objects.select("doc_id", F.lit("JavaScript objects in the file").alias("title"), F.lit("JavaScript objects").alias("technique"), F.concat(F.col("n").cast("string"), F.lit(" script objects")).alias("evidence")))


def text_sources(trace: Trace, pages: DataFrame) -> DataFrame:
    """Every channel of a document that holds text, blank ones are left out: doc_id, source, page, text.

    Beside these what detectors ask of a channel: kind (page, metadata, annotation, field), name (of a metadata
    field or form field, type of an annotation), unseen (whether an annotation or form field is not shown), bbox, hidden_text (of a page).
    """
    from palimpsest.functions.text import is_blank

    full = lambda *cs: F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in cs)).alias("text")
    number = (F.col("page") + 1).cast("string")
    none = {"page": "int", "name": "string", "unseen": "boolean", "bbox": "array<double>", "hidden_text": "string"}
    side = lambda i: F.coalesce(F.get("bbox", F.lit(i)), F.lit(0.0))
    flagged = lambda c, bits: F.coalesce(F.col(c).bitwiseAND(bits) != 0, F.lit(False))

    def rows(df: DataFrame, kind: str, source: Column, text: Column, **more: Column) -> DataFrame:
        rest = [(more[c] if c in more else F.lit(None)).cast(t).alias(c) for c, t in none.items()]
        return df.select("doc_id", source.alias("source"), rest[0], text.alias("text"), F.lit(kind).alias("kind"), *rest[1:])

    col = F.col
    parts = (
        rows(pages, "page", F.concat(F.lit("page "), number), col("text"), page=col("page"), hidden_text=col("hidden_text") if "hidden_text" in pages.columns else F.lit("")),
        rows(trace.metadata, "metadata", F.concat(F.lit("metadata/"), "key"), col("value"), name=col("key")),
        rows(trace.docs, "metadata", F.lit("XMP metadata"), col("xmp"), name=F.lit("xmp")),
        rows(trace.annots, "annotation", F.concat(F.lit("annotation on page "), number), full("content", "title", "subject"), page=col("page"), name=col("type"), unseen=flagged("flags", 2 | 32), bbox=col("bbox")),
        rows(trace.widgets, "field", F.concat(F.lit("form field on page "), number), full("value", "tooltip"), page=col("page"), name=col("name"), unseen=flagged("field_flags", 2) | (F.abs((side(2) - side(0)) * (side(3) - side(1))) < 1.0), bbox=col("bbox")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(~is_blank(F.col("text")))
