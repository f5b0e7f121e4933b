"""The registered queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, language_id, mpeg_audio, packing, piece_bpe, quality, sharding, simhash, site_tree, token_count, token_files, toxicity, vector_codes
from .storage import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: (doc_id, fingerprint, component_id). Null and empty texts share fingerprint 0 and one group; repeated rows stay."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents: (doc_id, n_tokens, ids_sha256, decoded_sha256). A null text is an empty one: no ids; repeated rows stay."""
    return piece_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards under the law ``bytes``; equal texts stay together, null and empty ones are equal; repeated rows get slots of their own."""
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=16)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens: a row a piece. A null or empty text is the separator alone; repeated rows are packed as often as they stand."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), separator=2, capacity=4096)


def remainder(doc_id: str, parts: int):
    """The fold of a document: the CRC-32 of its id as text; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


def held_out(parts: int, fold: int):
    """Is a document kept from training? One without an id is never trained on, and is in no fold: false."""
    return F.coalesce(remainder("doc_id", parts) == fold, F.lit(False)).alias("held_out")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: (doc_id, held_out, score, predicted, n_segments). Null and empty texts get the lowest score; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    found = toxicity.scored(docs, model)
    return found.select("doc_id", held_out(5, 0), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_segments")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents: (doc_id, held_out, lang_pred, score). Texts without a letter are ``und``; ties go to the first name; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.trained(docs, remainder("doc_id", 4) != 2)
    return language_id.predicted(docs, model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op6_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages: (page_id, url, text, n_chars). Null and empty pages have no text; repeated rows stay."""
    found = site_tree.extracted(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents. A null text measures like an empty one and fails the base rules; repeated rows stay."""
    book = quality.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails(quality.BASE).alias("base_failed"),
        (~quality.fails(quality.BASE) & ~quality.fails(quality.PRODUCTION)).alias("kept"), F.col("failed").alias("failed_rules"),
    )


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as MPEG audio and read back. A null text is an empty one: 64 zero bytes; repeated rows stay."""
    return mpeg_audio.digests(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents: (doc_id, n_bytes, n_tokens, over_limit). A null text counts 0 and 0; repeated rows stay."""
    found = token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: (vec_id, code, error, label_error, codebooks_sha256). Null vectors and those of null or non-finite components are dropped; repeated rows stay."""
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


def op12_re_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents from Re-Pair shards: (doc_id, start, n_tokens, ids_crc32). A null or empty text is the end id alone; null ids come first; repeated rows stay."""
    return token_files.read(token_files.written(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end=1), digest=True)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language of all documents are apart: (lang, source, part, item, value, rank). Nulls are ''; repeated rows count as often as they stand."""
    return divergence.audited(table(spark, sf_dir, "documents"))


def _lloyd_sql(rounds: int = 6) -> str:
    """Lloyd's rounds by full scans, a row for each component."""
    near = "SELECT r, p, min(d) // 16 AS d, min(d) % 16 AS k FROM (SELECT c.r, c.p, b.k, sum((c.x - b.x) * (c.x - b.x)) * 16 + b.k AS d FROM c JOIN b{0} b USING (p, i) GROUP BY c.r, c.p, b.k) GROUP BY r, p"
    mean = "SELECT p, i, k, (s - ((s % n) + n) % n) // n AS x FROM (SELECT c.p, c.i, a.k, CAST(sum(c.x) AS BIGINT) AS s, count(*) AS n FROM c JOIN a{0} a USING (r, p) GROUP BY c.p, c.i, a.k)"
    steps = [f"a{n} AS MATERIALIZED ({near.format(n)}), b{n + 1} AS MATERIALIZED (SELECT p, i, k, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN ({mean.format(n)}) m USING (p, i, k))" for n in range(rounds)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (SELECT r, (i - 1) * 8 // n AS p, i, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT c.p, c.i, s.k, c.x FROM c JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT 16) s USING (r)),
{", ".join(steps)},
a AS MATERIALIZED ({near.format(rounds)}),
e AS (SELECT r, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i)) FROM b{rounds}) AS codebooks_sha256 FROM v JOIN e USING (r)
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_site_tree": op6_site_tree,
    "op7_quality": op7_quality,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_re_pair": op12_re_pair,
    "op13_divergence": op13_divergence,
}
ORACLE: dict[str, str] = {
    "op7_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, p, array_to_string(ws[p:p + 4], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) > 4)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, p + k AS q FROM twice, (SELECT unnest(range(0, 5)) AS k)) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup.n_lines, 0) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed_rules FROM f
""",
    "op11_vector_codes": _lloyd_sql(),
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p, 1 + (1000000000 * (CAST(k.n AS HUGEINT) + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
}
