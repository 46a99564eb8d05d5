"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, chat, collocation, embedding_dedup, language_id, line_dedup, mixing, packing, quality, simhash, token_count, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: other vectors of its label within a cosine of 0.93, and the smallest id of its component."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its language by text, declaration, address suffix and host, and the probability of that."""
    return language_id.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, and for one that is full of control strings: digests of what is read back from its formatted text."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.format_conversations(rows)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(role, '<\|turn\|>|<\|sep\|>|<\|end\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>'))
    + len(regexp_extract_all(text, '<\|turn\|>|<\|sep\|>|<\|end\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>')) + 22 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: a score of its text, learned from rows that aren't held out."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go as exact and near repeats, and the size and digest of what stays."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts="gone")
    return out.select("doc_id", F.col("gone.lines").alias("n_lines"), F.col("gone.exact").alias("n_exact"), F.col("gone.near").alias("n_near"), F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint, and the smallest id of those linked with it."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its tokens' number and digest, and the digest of what they decode to."""
    return bpe.encode(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its tokens under a unigram model, counted without keeping pieces."""
    return token_count.token_counts(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words and domains, and how often the mix takes it."""
    out = mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    shares = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return out.select(F.col("id").alias("doc_id"), "n_tokens", *shares, "rate", "copies", "missed")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: statistics of its words and lines, the fixed rules, and the verdict of the trees."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector and component: its whitened value, and what the component explains; a deviation beyond a long is null."""
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document: where it lies in which sequence of 4096 tokens, and the checksum of its ids."""
    out = packing.pack(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: its 2000 best phrases of two and three words."""
    return collocation.collocations(_table(spark, sf_dir, "documents"), least=10, covered=50, most=2000)


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), grams AS (
  SELECT lang, list_slice(w, i, i + k - 1) AS g, k FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)
), counted AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, k, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 10
), around AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN around o USING (lang, phrase) WHERE o.around IS NULL OR 100 * o.around < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.c, h.f AS l, t.f AS r, (1000000::HUGEINT * u.a * u.a // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts u JOIN counted h ON h.lang = u.lang AND h.phrase = u.head JOIN counted t ON t.lang = u.lang AND t.phrase = u.tail
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_language_id, op3_chat_format, op4_toxicity, op5_line_dedup, op6_simhash_near_dedup, op7_byte_bpe, op8_token_counts, op9_mixing, op10_quality_rules, op11_embedding_whitening, op12_packing, op13_collocations)}
ORACLE_SQL = {"op3_chat_format": OP3_SQL, "op13_collocations": OP13_SQL}
