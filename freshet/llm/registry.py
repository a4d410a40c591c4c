"""Queries of the subpackage and their SQL."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import chat_query, common, cyk_repair, html_blocks, pfor_tokens, piece_bpe, signature_tree, subword_langid, threshold_topk, token_alignment, toxic_channel, warc_dictionary, winnow_decontam, winnow_fingerprint
from freshet.session import read_table, spread


def tokenizer_file(name: str) -> str:
    """A file of the installed public_tokenizers package, or of the folder in TOKENIZERS_DIR."""
    folder = os.environ.get("TOKENIZERS_DIR") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


ARCHIVE_DATE = "2024-01-01T00:00:00Z"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 1: every page archived and read back."""
    files = warc_dictionary.write(spread(read_table(spark, sf_dir, "pages")), ARCHIVE_DATE)
    return warc_dictionary.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2: fingerprints of every text and of its edited text."""
    return winnow_fingerprint.compare(read_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3: the main text of every page."""
    return html_blocks.extract(spread(read_table(spark, sf_dir, "pages")))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 4: every document's place and checksum, read back from the token files."""
    written = pfor_tokens.write(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return pfor_tokens.read(written).withColumnRenamed("_key", "doc_id")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5: set size and component of every document."""
    return signature_tree.components(spread(read_table(spark, sf_dir, "documents")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6: digests of the ids and of the text decoded from them."""
    return piece_bpe.digests(spread(read_table(spark, sf_dir, "documents")), tokenizer_file("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7: predictions for all documents, learned from three quarters of them."""
    documents = spread(read_table(spark, sf_dir, "documents"))
    model = subword_langid.train(documents, common.remainder("doc_id", 4) != 2)
    return subword_langid.predict(documents, model).withColumn("held_out", common.remainder("doc_id", 4) == 2).drop("_sign")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8: words inside benchmark windows and the items they come from."""
    found = winnow_decontam.contamination(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of all conversations linked, checked, ordered and written as canonical JSON."""
    return chat_query.steps(read_table(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10: scores of all documents, learned from four fifths of the labels."""
    documents = spread(read_table(spark, sf_dir, "documents"))
    scorer = toxic_channel.train(documents, read_table(spark, sf_dir, "labels"), common.remainder("doc_id", 5) != 0)
    return toxic_channel.score(documents, scorer).withColumn("held_out", common.remainder("doc_id", 5) == 0).drop("_sign")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 11: conversations damaged, judged and repaired at least cost."""
    return cyk_repair.repaired_conversations(read_table(spark, sf_dir, "conversations"))


def op12_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 12: the five best rows of every query."""
    return threshold_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 13: groups and links of the tokens of two tokenizers for every document."""
    return token_alignment.digests(spread(read_table(spark, sf_dir, "documents")), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_fingerprints": op2_fingerprints,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_output": op4_token_output,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_threshold_topk": op12_threshold_topk,
    "op13_token_alignment": op13_token_alignment,
}

# Words of a text as the contract defines them.
_WORDS8 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op11_conversation_repair": cyk_repair.SQL,
    "op12_threshold_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""",
    "op9_chat_formatting": chat_query.SQL,
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest, CAST(CAST(from_hex(sha1(payload)) AS BIT) AS VARCHAR) AS bits FROM p),
r AS (SELECT digest, max(page_id) AS response FROM h GROUP BY digest)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
    + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM h JOIN r USING (digest)
""",
    "op5_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingle a JOIN shingle b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN size i ON i.doc_id = x JOIN size j ON j.doc_id = y WHERE 100 * o >= 75 * (i.n + j.n - o)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT x, x FROM edge UNION SELECT r.a, e.y FROM reach r JOIN edge e ON e.x = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
i AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM iw),
hit AS (
  SELECT t.doc_id, t.s, t.n, iw.item_id
  FROM (
    SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
  ) t JOIN iw ON iw.n = t.n AND iw.win = t.win
),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
  FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
