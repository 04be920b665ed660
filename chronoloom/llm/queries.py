"""The text operators as queries over whole tables, with SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, line_dedup, media, multi_index, passages, secret_scan, sharding, toxicity, trie, whitening
from .common import table


def op1_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.media_column(table(spark, sf_dir, "documents"), keep_media=False)
    feature = F.concat_ws(":", F.size("fingerprint").cast("string"), F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ","), 256))
    return made.withColumn("feature", feature).drop("media")


def op2_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 40)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.summaries(chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs, line_dedup.LineIndex.of(docs), whole=False)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents")).drop("secrets")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_fingerprints, op2_byte_bpe, op3_rendezvous_shards, op4_decontamination, op5_chat_format, op6_ngram_jaccard, op7_line_dedup, op8_secret_scan, op9_repeated_passages, op10_toxicity, op11_whitening, op12_multi_index, op13_prefix_trie)}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: What SQL can say in reasonable time on whole tables; the others are tested against brute force.
SQL: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, i, pos.n FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_chat_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (len(regexp_extract_all(text, '</?s>'))) + 4 * len(regexp_extract_all(text, '\\[/?INST\\]')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN 7 + n ELSE 14 + length(role) + n END) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""",
    "op6_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT node AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node""",
    "op7_line_dedup": f"""
WITH l AS (SELECT doc_id, i, s[i] AS line, {LOWER.format(f"trim(s[i], {BLANK})")} AS key FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
h AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
k AS (SELECT l.*, h.key IS NOT NULL AND doc_id <> last AS drop FROM l LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drop), '')) AS kept_sha256 FROM k GROUP BY doc_id""",
    "op13_prefix_trie": """
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS tab),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) - 1 AS i FROM (SELECT conv_id AS c, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
v AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a >> 8, tab[CAST(xor(a, x) & 255 AS INT) + 1]), 4294967295), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t), k),
r AS (SELECT v.c, i, m, words FROM v JOIN t ON t.c = base WHERE i < h UNION ALL SELECT v.c, i, m, words FROM v JOIN t USING (c) WHERE i >= h),
p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY i)) AS p, words FROM r UNION ALL SELECT c, 0, '', 0 FROM v),
n AS (SELECT p, d, min(c) AS owner, count(*) AS n, max(words) AS words FROM p GROUP BY ALL),
up AS (SELECT n.p, u.p AS above FROM n JOIN p u ON u.c = n.owner AND u.d = n.d - 1),
kids AS (SELECT above AS p, count(*) AS kids FROM up GROUP BY 1),
sub AS (SELECT a.p, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (WHERE kids IS NULL) AS leaves FROM n LEFT JOIN kids USING (p) JOIN p a ON a.c = n.owner AND a.d <= n.d GROUP BY 1),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS said FROM (SELECT c, arg_max(p, d) AS p FROM p GROUP BY 1) GROUP BY 1)
SELECT n.owner AS conv_id, n.d AS depth, o.owner AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(said, '')) AS ends_sha256
FROM n LEFT JOIN up USING (p) LEFT JOIN n o ON o.p = up.above LEFT JOIN kids ON kids.p = n.p JOIN sub ON sub.p = n.p LEFT JOIN ends ON ends.p = n.p""",
}
