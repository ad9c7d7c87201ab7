"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.llm import chat, decontam, idfile, jaccard, licenses, neardup, packing, pii, quality, toxicity, variants, warc, whitening
from raresift.llm.frames import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- chat formatting ------------------------------------------------------------------------------

TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like the template's own marks, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chat(turns.unionByName(extra)))


QUERIES["op1_chat_format"] = op1_chat_format
_QUOTED = "replace(replace(replace({}, '\\', '\\\\'), '#', '\\#'), '</turn>', '\\</turn>')"
ORACLES["op1_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
n AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(replace({_QUOTED.format('role')}, ':', '\\:')) + 2 + length({_QUOTED.format('text')}) + 8) AS BIGINT)
    AS formatted_chars,
  coalesce(bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
    WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role IN ('assistant', 'tool')
    WHEN before = 'tool' THEN role IN ('assistant', 'tool')
    WHEN before = 'assistant' THEN role IN ('user', 'tool') ELSE false END), false)
    AND bool_or(from_end = 1 AND role = 'assistant') AS accepted
FROM n GROUP BY conv_id"""


# --- embedding near-duplicates --------------------------------------------------------------------


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES["op2_embedding_dedup"] = op2_embedding_dedup
ORACLES["op2_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT id, min(other) AS low FROM reach GROUP BY id) c ON c.id = e.vec_id"""


# --- packing --------------------------------------------------------------------------------------


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


QUERIES["op4_packing"] = op4_packing


# --- WARC -----------------------------------------------------------------------------------------


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op6_warc"] = op6_warc
ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id > f.first_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""


# --- toxicity -------------------------------------------------------------------------------------


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op9_toxicity"] = op9_toxicity


# --- quality --------------------------------------------------------------------------------------


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                             (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES["op10_quality"] = op10_quality


# --- n-gram Jaccard join --------------------------------------------------------------------------


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


QUERIES["op5_ngram_join"] = op5_ngram_join
ORACLES["op5_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(other) AS low FROM reach GROUP BY id) c ON c.id = w.doc_id"""


# --- benchmark decontamination --------------------------------------------------------------------


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op3_decontamination"] = op3_decontamination


# --- personal data --------------------------------------------------------------------------------

KEY = b"fixed key of the registered query; give your own"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, KEY, count_col="n_replaced")


QUERIES["op7_pii"] = op7_pii


# --- license scan ---------------------------------------------------------------------------------


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES["op8_license_scan"] = op8_license_scan


# --- token-id files -------------------------------------------------------------------------------


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.read_documents(idfile.write_ids(table(spark, sf_dir, "documents"), tokenizer_file()))


QUERIES["op11_token_files"] = op11_token_files


# --- whitening ------------------------------------------------------------------------------------


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))  # an error where 64 bits are too few


QUERIES["op13_whitening"] = op13_whitening


# --- spelling variants ----------------------------------------------------------------------------


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES["op12_spelling_variants"] = op12_spelling_variants
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE crc AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, {_CRC_STEP} FROM crc WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS s FROM crc WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, length(run) AS len, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
bytes AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM each),
sums AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(x) // 2 AS BIGINT)),
    lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, s[CAST(xor(c & 255, b) + 1 AS BIGINT)]))) AS h FROM bytes, steps),
spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % len AS BIGINT)) || substr(run, CAST(h % len + 2 AS BIGINT)) ELSE run END AS word, n FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
ranked AS (
  SELECT a AS word, b AS other, w.n AS other_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS r
  FROM near JOIN words w ON w.word = near.b),
named AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
chain AS (SELECT word, word AS root, form AS next FROM named UNION ALL SELECT c.word, n.word, n.form FROM chain c JOIN named n ON n.word = c.next)
SELECT n.word, n.form, c.root, n.n, n.n_near, n.form_n FROM named n JOIN chain c ON c.word = n.word AND c.next IS NULL"""
