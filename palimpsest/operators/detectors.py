"""The detectors: what they look for in a ``Scan``, and the findings in one schema.

A detector is a list of rules over runs, texts, attachments or actions. All rules over one relation
are tested in one pass: each row is given the array of its findings, which is then exploded, so a scan with
all detectors reads runs once and texts once. The order of the detectors is part of the result (reports list
findings by it), and no detector depends on another one. ``register`` adds detectors of a caller's own; their rules join
the pass of their relation.

Each rule is tried: one that throws on a row makes no finding there and leaves all others, and ``evaluate`` says which
detector it was (``failed``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions import geometry as G
from palimpsest.functions import lexicon as X
from palimpsest.functions import text as T
from palimpsest.sources.traces import Trace

FINDING = ("doc_id", "code", "severity", "title", "detail", "technique", "evidence", "page", "bbox", "extra", "order")


@dataclass
class Scan:
    """A trace with what is derived from it once: classified spans, page texts and text sources."""

    trace: Trace
    spans: DataFrame
    pages: DataFrame
    sources: DataFrame


#: Names and what they look for, in the order of reports, with the codes of their findings and what each says.
DETECTORS: tuple[tuple[str, str, dict[str, str]], ...] = (
    ("invisible_render_mode", "Runs drawn without ink", {"invisible_render_mode": "The run is laid out but no ink is put down for it. Extractors don't look at ink."}),
    ("transparent_text", "Runs that are nearly transparent", {"transparent_text": "Next to nothing of the run shows, on screen or on paper. Extractors don't look at opacity."}),
    ("low_contrast_text", "Runs in the colour of what is behind them", {"low_contrast_text": "A reader needs a ratio of about 4.5 to 1, and sees nothing below about 1.2 to 1."}),
    ("micro_type", "Type too small to read", {"micro_type": "Below three points type is a grey line to a reader, and text like any other to an extractor."}),
    ("offpage_text", "Runs outside the page", {"offpage_text": "What lies beyond the page is neither shown nor printed, but it is extracted."}),
    ("covered_text", "Runs under a shape drawn later", {"covered_text": "A shape without gaps was drawn over the run. Extractors read what is drawn, not what is left of it."}),
    ("hidden_layer", "Runs on layers that are off", {"hidden_layer": "Viewers leave the layer out, most extractors don't."}),
    ("metadata_payload", "Instructions in metadata", {"metadata_payload": "No page shows metadata, but it is often put before the text that a model gets."}),
    ("annotation_payload", "Instructions and unseen text in annotations", {"annotation_payload": "Annotations are no part of a page, may be hidden by a flag, and are often extracted with it."}),
    ("form_field_payload", "Instructions and unseen text in form fields", {"form_field_payload": "Values and hints of fields are extracted even where the field is hidden or has no size."}),
    ("embedded_file", "Files inside the document", {"embedded_file": "A file inside a document passes filters that look at its pages."}),
    ("active_content", "Scripts and automatic actions", {"active_content": "The document wants to run or open something. One that is only read has no need to."}),
    ("unicode_smuggling", "Invisible, direction and tag characters", {
        "invisible_unicode": "Characters without width stay in extracted text, where they hide content or part words that a filter looks for.",
        "bidi_override": "What is read on the page and what is stored can be two different sentences.",
        "tag_smuggling": "Tag characters stand for ASCII and show nothing at all.",
    }),
    ("homoglyph", "Look-alike characters in Latin words", {"homoglyph": "Letters of other scripts that look like Latin ones make an address that isn't what it seems."}),
    ("injection", "Phrases addressed to a model", {
        "injection_hidden": "It addresses a model and stands where no reader sees it.",
        "injection_visible": "It addresses a model but stands in plain sight: worth a look, no proof.",
    }),
    ("layer_mismatch", "Pages whose text is hidden in part", {"layer_mismatch": "Nearly all text of an ordinary page is there to be read."}),
    ("encoding_anomaly", "Control and private-use characters", {"encoding_anomaly": "Nobody types such characters. They evade filters or are left over from a generated payload."}),
)
CODES = {code: (i, name, detail) for i, (name, _, codes) in enumerate(DETECTORS) for code, detail in codes.items()}
#: What a scan has that rules read, a row each.
RELATIONS = ("runs", "texts", "attachments", "actions")


@dataclass(frozen=True)
class Detector:
    """A detector: its name, what it looks for, the codes of its findings with what each says, and its rules over one of ``RELATIONS``.

    ``rules`` gives a column for each rule (``finding`` makes them), which is a finding or null. What the columns may name is
    what the relation has: runs as ``classify`` gives them, texts as ``text_sources`` does, attachments and actions as in traces.
    The detectors that are built in have no rules here, as theirs share what they read.
    """

    name: str
    info: str
    codes: dict[str, str] = field(hash=False)
    relation: str = ""
    rules: Callable[[], Iterable[Column]] | None = field(default=None, hash=False)


_REGISTRY: list[Detector] = [Detector(name, info, codes) for name, info, codes in DETECTORS]


def registered() -> tuple[Detector, ...]:
    """All detectors in the order of reports."""
    return tuple(_REGISTRY)


def register(detector: Detector, before: str | None = None) -> Detector:
    """Add a detector, last or before another one. Its name and codes must be new, and its rules over a relation that there is."""
    if detector.relation not in RELATIONS or detector.rules is None:
        raise ValueError(f"{detector.name}: rules over one of {RELATIONS} are needed")
    taken = {d.name for d in _REGISTRY} | {c for d in _REGISTRY for c in d.codes}
    if clash := taken & {detector.name, *detector.codes}:
        raise ValueError(f"{detector.name}: {sorted(clash)} are taken")
    at = next(i for i, d in enumerate(_REGISTRY) if d.name == before) if before else len(_REGISTRY)
    _REGISTRY.insert(at, detector)
    return detector


def unregister(name: str) -> None:
    """Take a detector of a caller's own away."""
    found = next(d for d in _REGISTRY if d.name == name)
    if found.rules is None:
        raise ValueError(f"{name} is built in")
    _REGISTRY.remove(found)


@contextmanager
def registering(*detectors: Detector) -> Iterator[None]:
    """With these detectors registered, and without them after."""
    try:
        for d in detectors:
            register(d)
        yield
    finally:
        for d in detectors:
            if d in _REGISTRY:
                unregister(d.name)


#: The codes that look for phrases.
_PHRASES = ("metadata_payload", "annotation_payload", "form_field_payload", "injection_hidden", "injection_visible")


def _sev(*cases: tuple[Column, str], default: str) -> Column:
    out = F.lit(default)
    for test, name in reversed(cases):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def finding(code: str, test: Column, severity: Column | str, title: Column | str, technique: Column | str, evidence: Column, extra: Column, order: Column, detail: str = "") -> Column:
    """A finding where the test holds, else null. ``extra`` is a struct of whatever else is to be told; ``order`` is that of findings of one code on one page."""
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    fields = {"code": F.lit(code), "severity": text(severity), "title": text(title), "detail": F.lit(detail), "technique": text(technique), "evidence": T.clip(evidence), "extra": F.to_json(extra), "order": order.cast("long")}
    return F.when(test, F.struct(*(F.coalesce(v, F.lit("")).alias(k) if k not in ("extra", "order") else v.alias(k) for k, v in fields.items())))


def _finding(code: str, *parts) -> Column:
    return finding(code, *parts, detail=CODES[code][2])


def _told(*parts: Column | str) -> Column:
    """Parts of a title, one after the other; null parts are left out."""
    return F.concat_ws("", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


@lru_cache(32)
def _made(make: Callable, wanted: frozenset, application: str) -> tuple[Column, ...]:
    """The columns of ``make(wanted)``. They name no table, so an application makes them once, however many micro-batches it scans."""
    return tuple(make(wanted))


def _columns(df: DataFrame, make: Callable, wanted: set[str] = frozenset()) -> tuple[Column, ...]:
    return _made(make, frozenset(wanted), df.sparkSession.sparkContext.applicationId)


_OWN = ("code", "severity", "title", "detail", "technique", "evidence", "extra", "order")
_JSON = ", ".join(f"{c} {'long' if c == 'order' else 'string'}" for c in _OWN)


def _tried(value: Column) -> Column:
    """A finding as JSON, ``{}`` for none, and null where making it throws."""
    return F.decode(F.try_to_binary(F.to_json(F.struct(value.alias("f"))), F.lit("UTF-8")), "UTF-8")


def _found(df: DataFrame, findings: Iterable[tuple[str, Column]], box: Column | None = None) -> DataFrame:
    """The findings of rows, by pairs (name of the detector, rule), and a row with ``failed`` for each rule that threw. ``box`` says what a finding's bbox is made of."""
    tried = F.array(*(F.struct(F.lit(name).alias("detector"), _tried(rule).alias("j")) for name, rule in findings))
    rows = df.select("doc_id", "page", "bbox", F.explode(F.filter(tried, lambda t: t["j"].isNull() | (t["j"] != "{}"))).alias("t"))
    rows = rows.select("doc_id", "page", "bbox", "t.detector", F.col("t.j").isNull().alias("failed"), F.from_json("t.j", f"f struct<{_JSON}>").alias("j"))
    own = {"doc_id": F.col("doc_id"), "page": F.col("page").cast("int").alias("page"), "bbox": (F.col("bbox") if box is None else box).cast("array<double>").alias("bbox")}
    return rows.select(*(own.get(c, F.col(f"j.f.{c}").alias(c)) for c in FINDING), "detector", "failed")


def _named(df: DataFrame, make: Callable, wanted: set[str], more: list[Detector]) -> list[tuple[str, Column]]:
    """The rules of what is built in, and those of other detectors, with the detectors' names."""
    order = [c for c in CODES if c in wanted]
    return [*zip((CODES[c][1] for c in order), _columns(df, make, wanted), strict=True), *((d.name, rule) for d in more for rule in d.rules())]


# runs -------------------------------------------------------------------------------------------------------


def _run_findings(wanted: set[str]) -> Iterator[Column]:
    text, size = F.col("text"), F.bround("eff_size", 2)
    order = F.col("page") * F.lit(1 << 20) + F.col("span_ord")
    inked = F.col("type") != 3
    share = F.coalesce(F.col("image_share"), F.lit(0.0))
    rules = {
        "invisible_render_mode": (~inked, _sev((share > 0.6, "low"), default="critical"), F.when(share > 0.6, "Text without ink on a scanned page").otherwise("Text drawn without ink"), "render mode", F.struct("font", size.alias("size"))),
        "transparent_text": (F.col("opacity") <= 0.08, _sev((F.col("opacity") <= 0.02, "critical"), default="high"), _told("Text at ", T.pct(F.col("opacity")), " opacity"), "opacity", F.struct(F.bround("opacity", 3).alias("opacity"))),
        "low_contrast_text": (inked & (F.col("ratio") < 1.6), _sev((F.col("ratio") < 1.12, "critical"), (F.col("ratio") < 1.35, "high"), default="medium"), _told("Text at ", _fixed(F.col("ratio"), 2), ":1 to what is behind it"), "colour", F.struct(F.bround("ratio", 3).alias("ratio"), F.col("hex").alias("fg"), F.col("bg_hex").alias("bg"), size.alias("size"))),
        "micro_type": (inked & (F.col("eff_size") > 0) & (F.col("eff_size") < 3.5) & (F.length(T.strip(text)) >= 4), _sev((F.col("eff_size") < 2.0, "critical"), default="high"), _told("Text of ", _fixed(F.col("eff_size"), 2), "pt"), "size", F.struct(size.alias("size"), "font")),
        "offpage_text": (F.col("visible") < 0.35, _sev((F.col("visible") < 0.02, "critical"), default="high"), "Text outside the page", "position", F.struct(F.bround("visible", 3).alias("visible_fraction"), F.array("box.x0", "box.y0", "box.x1", "box.y1").alias("page_box"))),
        "covered_text": (inked & F.col("cover").isNotNull(), "high", "Text under an opaque shape", "draw order", F.struct(F.col("cover.hex").alias("cover_fill"), F.array("cover.rect.x0", "cover.rect.y0", "cover.rect.x1", "cover.rect.y1").alias("cover_rect"))),
        "hidden_layer": (F.col("layer_off"), "high", _told("Text on the layer “", T.strip(F.col("layer")), "”, which is off"), "layer", F.struct(T.strip(F.col("layer")).alias("layer"))),
    }
    for code, (test, severity, title, technique, extra) in rules.items():
        if code in wanted:
            yield _finding(code, test, severity, title, technique, text, extra, order)


def _of_runs(s: Scan, wanted: set[str], more: list[Detector]) -> DataFrame:
    box = F.when(F.col("bbox").isNotNull(), F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")).otherwise(F.array())
    return _found(s.spans.where(~T.is_blank(F.col("text"))), _named(s.spans, _run_findings, wanted, more), box)


# texts ------------------------------------------------------------------------------------------------------


def top_characters(text: Column, characters: str, n: int = 4) -> Column:
    """The ``n`` most frequent of these characters in a text, (char, count); of equals the one that comes first."""
    each = F.array(*(F.struct((-T.count_of(text, c)).alias("order"), F.instr(text, c).alias("first"), F.lit(f"U+{ord(c):04X}").alias("char"), T.count_of(text, c).alias("count")) for c in characters))
    return F.transform(F.slice(F.sort_array(F.filter(each, lambda x: x["count"] > 0)), 1, n), lambda x: F.struct(x["char"], x["count"]))


def _listed(top: Column) -> Column:
    return F.array_join(F.transform(top, lambda x: F.concat(x["char"], F.lit(" ×"), x["count"].cast("string"))), ", ")


def mixed_tokens(text: Column) -> Column:
    """Tokens of four code points or more with look-alikes among Latin letters: array of (token, plain, target), null where there is none.

    ``target`` says whether the token is part of an address of the text. Addresses hold no white space, so they are looked for in tokens.
    """
    odd = lambda ts: F.filter(ts, lambda t: (T.unmask(t) != t) & t.rlike("[A-Za-z]"))
    told = lambda odd, urls: F.transform(odd, lambda t: F.struct(t.alias("token"), T.unmask(t).alias("plain"), F.exists(urls, lambda u: F.contains(u, t)).alias("target")))
    aimed = lambda x: F.when(F.size(x["odd"]) > 0, T.bound(T.addresses(x["tokens"]), lambda urls: told(x["odd"], urls)))
    tokens = F.regexp_extract_all(text, F.lit(f"[^{X.WS[1:-1]}]{{4,}}"), F.lit(0))
    found = T.bound(tokens, lambda ts: T.bound(F.struct(odd(ts).alias("odd"), ts.alias("tokens")), aimed))
    return F.when(F.translate(text, X.LOOKALIKE, "") != text, found)


def _text_findings(wanted: set[str]) -> Iterator[Column]:
    text, source, kind = F.col("text"), F.col("source"), F.col("kind")
    order = F.crc32(source)
    shown = kind != "hidden"
    first, hit = F.get("hits", F.lit(0)), F.size("hits") > 0
    top = F.coalesce(first["weight"], F.lit(0))
    few = lambda hits, n: F.transform(F.slice(hits, 1, n), lambda h: F.struct(h["label"], h["weight"], h["start"], h["end"], h["match"])).alias("hits")

    def characters(code: str, of: str, severity: Callable[[Column], Column | str], title: Callable[[Column], Column | str]) -> Column:
        def told(these: Column) -> Column:  # the text without all others
            n, tops = F.length(these).cast("long"), top_characters(these, of)
            return _finding(code, F.lit(True), severity(n), title(n), "unicode", _listed(tops), F.struct(source.alias("where"), n.alias("n"), tops.alias("top")), order)

        return F.when(shown & (T.count_of(text, of) > 0), T.bound(F.regexp_replace(text, f"[^{of}]", ""), told))

    if "metadata_payload" in wanted:
        yield _finding("metadata_payload", (kind == "metadata") & hit, _sev((top >= X.CONFIRMED, "critical"), default="medium"), _told("Instructions in the metadata field ", F.col("name")), "metadata", text, F.struct(F.col("name").alias("key"), few("hits", 4)), F.crc32("name"))
    if "annotation_payload" in wanted:
        unseen = F.col("unseen")
        title = F.when(unseen, F.lit("Text in an annotation that isn't shown")).otherwise(_told("Instructions in an annotation of type ", F.col("name")))
        yield _finding("annotation_payload", (kind == "annotation") & (hit | unseen), _sev((hit & unseen, "critical"), (hit, "high"), default="medium"), title, F.when(unseen, "annotation (hidden)").otherwise("annotation"), text, F.struct(F.col("name").alias("type"), unseen.alias("hidden"), few("hits", 4)), F.col("page"))
    if "form_field_payload" in wanted:
        name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("unnamed"))
        yield _finding("form_field_payload", (kind == "field") & (hit | F.col("unseen")), _sev((hit, "high"), default="low"), _told("Text in the form field “", name, "”"), "form field", text, F.struct(F.col("name").alias("field"), F.col("unseen").alias("hidden"), few("hits", 4)), F.col("page"))
    if "invisible_unicode" in wanted:
        yield characters("invisible_unicode", X.INVISIBLE, lambda n: _sev((n < 12, "medium"), default="high"), lambda n: _told(n.cast("string"), " characters without width in ", source))
    if "bidi_override" in wanted:
        yield characters("bidi_override", X.BIDI, lambda n: "high", lambda n: "Characters that turn the direction of text")
    if "tag_smuggling" in wanted:
        n, decoded = F.regexp_count(text, F.lit(X.TAGS)).cast("long"), T.decode_tags(text)
        evidence = F.when(T.is_blank(decoded), F.concat(n.cast("string"), F.lit(" tag characters"))).otherwise(decoded)
        yield _finding("tag_smuggling", shown & text.rlike(X.TAGS), "critical", "ASCII in tag characters", "unicode", evidence, F.struct(source.alias("where"), n.alias("n"), T.clip(decoded, 1000).alias("decoded")), order)
    if "homoglyph" in wanted:
        odd = F.col("odd")
        aimed = F.filter(odd, lambda x: x["target"])
        few_odd = F.slice(F.when(F.size(aimed) > 0, aimed).otherwise(odd), 1, 5)
        title = F.when(F.size(aimed) > 0, "Look-alike characters in an address").otherwise(_told(F.size(odd).cast("string"), " words with look-alike characters"))
        yield _finding("homoglyph", F.size(odd) > 0, _sev((F.size(aimed) > 0, "high"), default="medium"), title, "unicode", F.array_join(F.transform(few_odd, lambda x: F.concat(x["token"], F.lit(" reads "), x["plain"])), "; "), F.struct(source.alias("where"), F.size(odd).alias("n"), few_odd.alias("tokens")), order)
    if "injection_hidden" in wanted:
        score = F.aggregate("hits", F.lit(0), lambda a, h: a + h["weight"])
        yield _finding("injection_hidden", (kind == "hidden") & hit, "critical", _told("Hidden instructions to a model: ", F.lower(first["label"])), "prompt injection", T.clip(first["match"], 300), F.struct(score.alias("score"), few("hits", 8), T.clip(text, 2000).alias("full")), F.col("page") * 2)
    if "injection_visible" in wanted:
        seen = T.not_within(F.col("hits"), F.col("hidden_text"))
        first_seen = F.get(seen, F.lit(0))
        most = F.coalesce(first_seen["weight"], F.lit(0))
        yield _finding("injection_visible", (kind == "page") & (F.size(seen) > 0), _sev((most >= X.CONFIRMED, "high"), (most >= X.SUSPECT, "medium"), default="low"), _told("Instructions to a model in plain sight: ", F.lower(first_seen["label"])), "prompt injection", T.clip(first_seen["match"], 300), F.struct(few(seen, 8)), F.col("page") * 2 + 1)
    if "layer_mismatch" in wanted:
        def compared(x: Column) -> Column:  # both inks are counted once
            total, unseen = x["total"], x["unseen"]
            share = F.try_divide(unseen, total)
            return _finding("layer_mismatch", (total >= 200) & (unseen >= 40) & (share >= 0.12), _sev((share > 0.3, "high"), default="medium"), _told(T.pct(share), " of the page's text is hidden"), "comparison", _told(unseen.cast("string"), " hidden characters of ", total.cast("string")), F.struct(total.alias("total"), unseen.alias("unseen"), F.bround(share, 4).alias("share")), F.col("page"))

        yield F.when((kind == "page") & (F.length(F.col("hidden_text")) >= 40), T.bound(F.struct(T.ink(text).alias("total"), T.ink(F.col("hidden_text")).alias("unseen")), compared))
    if "encoding_anomaly" in wanted:
        controls, private = F.regexp_count(text, F.lit(X.CONTROLS)).cast("long"), F.regexp_count(text, F.lit(X.PRIVATE_USE)).cast("long")
        some = text.rlike(X.CONTROLS[:-1] + X.PRIVATE_USE[1:])  # few texts have any of either, so only these are counted
        evidence = F.concat_ws(" and ", F.when(controls > 0, F.concat(controls.cast("string"), F.lit(" control characters"))), F.when(private >= 3, F.concat(private.cast("string"), F.lit(" private-use characters"))))
        yield _finding("encoding_anomaly", shown & some & (text.rlike(X.CONTROLS) | (private >= 3)), "medium", _told("Odd characters in ", source), "encoding", evidence, F.struct(source.alias("where"), controls.alias("controls"), private.alias("private")), order)


def _hits(_: frozenset) -> Iterator[Column]:
    yield T.injection_hits(F.col("text"))


def _mixed(_: frozenset) -> Iterator[Column]:
    yield mixed_tokens(F.col("text"))


def _of_texts(s: Scan, wanted: set[str], more: list[Detector]) -> DataFrame:
    rows = s.sources
    if "injection_hidden" in wanted:  # the hidden text of a page is a row of its own
        hidden = F.struct(F.lit("hidden").alias("kind"), F.col("hidden_text").alias("text"))
        both = F.array(F.struct("kind", "text"), F.when((F.col("kind") == "page") & ~T.is_blank(F.col("hidden_text")), hidden))
        rest = [c for c in rows.columns if c not in ("kind", "text")]
        rows = rows.select(*rest, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select(*rest, "x.kind", "x.text")
    kinds = {"metadata_payload": "metadata", "annotation_payload": "annotation", "form_field_payload": "field", "injection_hidden": "hidden", "injection_visible": "page"}
    if asked := [kinds[c] for c in _PHRASES if c in wanted]:
        # a page's hidden text is part of its text: without a phrase in that there is none in it
        rows = rows.withColumn("hits", F.when(F.col("kind").isin(asked), _columns(rows, _hits)[0]))
    if "homoglyph" in wanted:
        rows = rows.withColumn("odd", F.when(F.col("kind") != "hidden", _columns(rows, _mixed)[0]))
    return _found(rows, _named(rows, _text_findings, wanted, more))


# what documents carry -----------------------------------------------------------------------------------------


def _embedded_file(_: frozenset) -> Iterator[Column]:
    name = F.coalesce("name", F.lit(""))
    size = F.coalesce("size", F.lit(0).cast("long")).cast("string")
    yield _finding("embedded_file", F.lit(True), "medium", _told("The file “", name, "” is inside the document"), "attachment", _told(name, ", ", size, " bytes"), F.struct("name", "size", "desc"), F.crc32(name))


def _active_content(_: frozenset) -> Iterator[Column]:
    title = F.coalesce("title", F.lit(""))
    yield _finding("active_content", F.lit(True), "high", title, F.coalesce("technique", F.lit("active content")), F.coalesce("evidence", F.lit("")), F.struct("title", "technique", "evidence"), F.crc32(title))


def _carried(df: DataFrame, make: Callable, wanted: set[str], more: list[Detector]) -> DataFrame:
    return _found(df.withColumns({"page": F.lit(None).cast("int"), "bbox": F.lit(None).cast("array<double>")}), _named(df, make, wanted, more))


_RUNS = set(list(CODES)[:7])
_TEXTS = set(CODES) - _RUNS - {"embedded_file", "active_content"}


def _codes(scan: Scan, wanted: set[str], more: Iterable[Detector] = ()) -> DataFrame:
    """One pass over each relation that a wanted code or another detector reads."""
    parts: dict[str, tuple[set[str], Callable]] = {
        "runs": (_RUNS, lambda w, m: _of_runs(scan, w, m)), "texts": (_TEXTS, lambda w, m: _of_texts(scan, w, m)),
        "attachments": ({"embedded_file"}, lambda w, m: _carried(scan.trace.attachments, _embedded_file, w, m)),
        "actions": ({"active_content"}, lambda w, m: _carried(scan.trace.actions, _active_content, w, m)),
    }
    out = None
    for relation, (codes, part) in parts.items():
        own = [d for d in more if d.relation == relation]
        if codes & wanted or own:
            found = part(codes & wanted, own)
            out = found if out is None else out.unionByName(found)
    return out


def detector(code: str) -> Callable[[Scan], DataFrame]:
    """The findings of one code of a scan."""
    return lambda scan: _codes(scan, {code}).where(~F.col("failed")).select(*FINDING)


def evaluate(scan: Scan, only: tuple[str, ...] = ()) -> DataFrame:
    """The findings of all registered detectors (or of these) with detector, detector_ord, weight, and ``failed``.

    A row where ``failed`` is true says that a rule of the detector threw at that place of the document; all else of it is null.
    """
    use = [d for d in _REGISTRY if not only or d.name in only]
    weight = F.coalesce(*(F.when(F.col("severity") == k, F.lit(v)) for k, v in X.WEIGHTS.items()))
    place = F.create_map(*(F.lit(x) for i, d in enumerate(_REGISTRY) for x in (d.name, i)))
    found = _codes(scan, {c for d in use if d.rules is None for c in d.codes}, [d for d in use if d.rules is not None])
    return found.withColumn("detector_ord", F.element_at(place, F.col("detector"))).withColumn("weight", weight)


def find(scan: Scan, only: tuple[str, ...] = ()) -> DataFrame:
    """The findings of all registered detectors (or of these), with detector, detector_ord and weight."""
    return evaluate(scan, only).where(~F.col("failed")).drop("failed")


def failures(scan: Scan, only: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, detector, n): at how many places of a document rules of a detector threw."""
    return evaluate(scan, only).where("failed").groupBy("doc_id", "detector").agg(F.count("*").alias("n"))
