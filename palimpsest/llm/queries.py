"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and benchmark items that greedy string tiling finds."""
    from palimpsest.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    from palimpsest.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from its record files."""
    import public_tokenizers

    from palimpsest.llm.token_records import read_records, write_records

    manifest = write_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_word=True, end_id=2)
    return read_records(manifest)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and its edited text, and their likeness."""
    from palimpsest.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of -7, whose texts hold control strings."""
    from pyspark.sql import functions as F

    from palimpsest.llm.chat import as_parts, digests, format_chats

    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema))
    return digests(format_chats(rows.withColumn("parts", as_parts(F.col("text")))))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document under the unigram vocabulary of the 32k piece model."""
    import public_tokenizers

    from palimpsest.llm.token_count import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    from palimpsest.llm.html_extract import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, n_tokens, bin, offset of every document."""
    import public_tokenizers

    from palimpsest.llm.packing import document_sizes, pack_documents

    sizes = document_sizes(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_word=True)
    return pack_documents(sizes)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data of every document."""
    from palimpsest.llm.pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    from palimpsest.llm.toxicity import scored

    return scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation, after damage."""
    from palimpsest.llm.chat_repair import damaged, repair_report

    rows = _table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading whitened components of every embedding."""
    from palimpsest.llm.whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    from palimpsest.llm.quality import judged

    return judged(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_jaccard_join, op3_token_records, op4_fingerprints, op5_chat_formatting, op6_token_counts, op7_html_extraction, op8_best_fit_packing, op9_personal_data, op10_toxicity, op11_conversation_repair, op12_embedding_whitening, op13_quality_rules, pipeline)}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: All pairs that share a shingle, by brute force, and what links reach.
_OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n + m - c)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, sh"""
#: Where a backslash is put before what follows: each of these once, and each backslash.
_CONTROLS = ("<|", "<s>", "</s>", "<SYS>>", "<<SYS>>", "</SYS>>", "<</SYS>>", "<//SYS>>", "</<SYS>>", "</</SYS>>", "[INST]", "[/INST]", "\\")
_ADDED = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in _CONTROLS)
_OP5 = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(8 + length(role) + 1 + length(text) + 5 + {_ADDED}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

#: CRC-32 bit by bit: of each byte its exclusive or first, then eight shifts.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(ascii(substr(k, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
 lambda c, b: xor(xor(c, b) // 2, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384 ELSE 0 END))"""
#: The cheapest edits by dynamic programming over rows and the four states of the role grammar: at the start (0), after s, u, a (1, 2, 3).
_OP11 = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT *, xor({_CRC}, 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, left(role, 1) AS ini FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i FROM t),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
 lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM n),
ins(p, q, m, e, w) AS (VALUES (0, 0, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])),
ed(p, l, q, m, e, r) AS (VALUES (0, 's', 1, 0, 'K', ''), (0, 'u', 2, 0, 'K', ''), (1, 'u', 2, 0, 'K', ''), (3, 'u', 2, 0, 'K', ''), (2, 'a', 3, 0, 'K', ''), (0, '', 2, 3, 'R', 'user'), (1, '', 2, 3, 'R', 'user'), (3, '', 2, 3, 'R', 'user'), (2, '', 3, 3, 'R', 'assistant'), (0, '', 0, 4, 'D', ''), (1, '', 1, 4, 'D', ''), (2, '', 2, 4, 'D', ''), (3, '', 3, 4, 'D', '')),
ids AS (SELECT DISTINCT conv_id FROM conversations),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS made FROM ids
 UNION ALL
 SELECT conv_id, i, st, best.cost, best.audit, best.made FROM (
  SELECT r.conv_id, f.i, ed.q AS st, arg_min({{'cost': r.cost + ins.m + ed.m + CASE WHEN ed.e <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': r.audit || ins.e || ed.e, 'made': list_concat(r.made, ins.w, CASE ed.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [ed.r || ':' || f.text] END)}},
   {{'c': r.cost + ins.m + ed.m + CASE WHEN ed.e <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, 'a': r.audit || ins.e || ed.e}}) AS best
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN ins ON ins.p = r.st JOIN ed ON ed.p = ins.q
  WHERE CASE ed.e WHEN 'D' THEN true WHEN 'K' THEN f.fault IN ('', 'truncated') AND f.ini = ed.l ELSE f.fault IN ('', 'truncated') END GROUP BY r.conv_id, f.i, ed.q)),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
 count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT r.conv_id, arg_min({{'cost': r.cost + ins.m, 'audit': r.audit || ins.e, 'made': list_concat(r.made, ins.w)}}, {{'c': r.cost + ins.m, 'a': r.audit || ins.e}}) AS best
 FROM r LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id JOIN ins ON ins.p = r.st AND ins.q IN (0, 3) WHERE r.i = coalesce(g.n, 0) GROUP BY r.conv_id)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.made, chr(10))) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": _OP11, "op2_jaccard_join": _OP2, "op5_chat_formatting": _OP5}
