"""Registered queries of the corpus operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statetrail.llm import align, bpe, chat, debruijn, fingerprint, hnsw, jaccard, licenses, linedup, mixing, packing, ranked, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query
def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.fingerprint_edits(documents(spark, sf_dir))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    return licenses.scan_licenses(documents(spark, sf_dir))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: A conversation whose texts look like marks of templates.
ODD = r"\### Assistant: </turn> ok"


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, folded from its event log, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], "conv_id bigint, turn bigint, role string, text string")
    return chat.format_conversations(turns.unionByName(odd))


ORACLES["op6_chat"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ODD}' UNION ALL SELECT -7, 1, 'assistant', '{ODD}'
), e AS (
  SELECT *, 17 + 5 * length(role) - length(replace(role, chr(92), '')) - length(replace(role, '<', '')) - length(replace(role, '>', '')) - length(role) + 5 * length(text) - length(replace(text, chr(92), '')) - length(replace(text, '<', '')) - length(replace(text, '>', '')) - length(text) AS size FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.digest_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of runs of two lines or more."""
    return linedup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLES["op10_line_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d
), s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), p AS (
  SELECT a.doc_id, a.seq, row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.seq) AS copy
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.seq = a.seq + 1
), gone AS (
  SELECT doc_id, seq FROM p WHERE copy > 1 UNION SELECT doc_id, seq + 1 FROM p WHERE copy > 1
), m AS (
  SELECT l.doc_id, l.pos, l.line, g.seq IS NOT NULL AS removed
  FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.pos = s.pos LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.seq = g.seq
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id 20 divides, among all others."""
    return hnsw.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of runs of 20 that also start earlier."""
    return debruijn.dedup_substrings(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(debruijn.words_joined(F.col("text")), 256).alias("kept_sha256")
    )


ORACLES["op4_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS copy FROM s
), gone AS (SELECT DISTINCT doc_id, i + o AS i FROM r, range(20) AS t(o) WHERE copy > 1),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
m AS (SELECT p.*, g.i IS NOT NULL AS removed FROM p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(*) FILTER (m.removed) AS n_removed,
  sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (NOT m.removed), '')) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.w
"""


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, as components."""
    return jaccard.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over every document, aligned."""
    return align.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item."""
    return ranked.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_ranked_search"] = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS d, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), n AS (SELECT d, doc_id, count(*) AS n FROM w GROUP BY d, doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
p AS (SELECT d, t, count(*) AS tf FROM w GROUP BY d, t),
q AS (
  SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t
), f AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s WHERE t IN (SELECT t FROM q) GROUP BY t, docs
), r AS (
  SELECT q.item_id, n.doc_id, CAST(sum(q.qtf * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + (25 * n.n * s.docs) // s.total)))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN p USING (t) JOIN n ON p.d = n.d, s GROUP BY q.item_id, n.d, n.doc_id
), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""


@query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources to their target weights takes of every document."""
    return mixing.mix_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLES["op13_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), a AS (SELECT CAST(sum(size) AS BIGINT) AS size, CAST(sum(weight) AS BIGINT) AS weight FROM s),
c AS (
  SELECT s.*, CAST(s.size AS DOUBLE) / s.weight AS ratio,
    a.size - 3 * CAST(coalesce(sum(s.size) OVER o, 0) AS BIGINT) AS remaining, a.weight - CAST(coalesce(sum(s.weight) OVER o, 0) AS BIGINT) AS shared
  FROM s, a WINDOW o AS (ORDER BY CAST(s.size AS DOUBLE) / s.weight, s.source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT remaining, shared FROM c WHERE 3 * size * shared > weight * remaining ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT s.source, s.size, coalesce(least(CAST(3 * s.size AS DOUBLE), CAST(s.weight * l.remaining AS DOUBLE) / l.shared), 3.0 * s.size) AS target
  FROM s LEFT JOIN l ON true
), p AS (SELECT source, CAST(sum(CAST(floor(target) AS BIGINT)) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS high, CAST(floor(target) AS BIGINT) AS words FROM t),
w AS (SELECT CAST(sum(words) AS BIGINT) AS total FROM p),
k AS (
  SELECT least(CAST(floor(((i * 2654435769) % 4294967296) / CAST(4294967296 AS DOUBLE) * w.total) AS BIGINT), w.total - 1) AS at
  FROM w, range((SELECT (total + 127) // 128 FROM w)) AS g(i)
), n AS (SELECT p.source, count(*) * 128 AS reach FROM k JOIN p ON k.at >= p.high - p.words AND k.at < p.high GROUP BY p.source),
b AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d
), e AS (
  SELECT b.doc_id, b.size, t.size AS source_size, t.target,
    list_sum(list_transform([0, 1, 2], lambda x: greatest(0, least(b.size, coalesce(n.reach, 0) - b.start - x * t.size)))) AS taken
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON b.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM e
"""
