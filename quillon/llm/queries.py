"""The queries opN_<name> and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import END, TEXT, TURN, chat_format, read_back
from .common import documents, stash
from .decontaminate import BLOCK_BYTES, decontaminate
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .history import SPAN, history
from . import lm_score
from .language_id import held_out, language_id, learn
from .license_scan import license_scan, summary
from .mixing import mix, sized
from .ngram_join import Alike, ngram_join
from .sharding import shard_documents
from .token_counts import token_counts
from .topk_search import top_k

#: \x00-\x7F but for digits and a-z, for RE2.
ALNUM_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(license_scan(documents(spark, sf_dir), keep=["doc_id"])).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=24).withColumnRenamed("id", "doc_id")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = lambda i: F.coalesce(F.crc32(i.cast("string")) % 7 == 2, F.lit(False))
    model = lm_score.train(docs.where(~held(F.col("doc_id"))))
    scored = lm_score.score(docs, model, keep=["doc_id"])
    return scored.select("row.doc_id", held(F.col("row.doc_id")), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score").toDF("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(documents(spark, sf_dir), "word_bpe_49k.json", limit=2048, keep=["doc_id"])
    return found.select("row.doc_id", "found.n_bytes", "found.n_tokens", (F.col("found.n_tokens") > 2048).alias("over_limit"), "found.fit_words", "found.fit_tokens", "found.fit_chars")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stash(sized(documents(spark, sf_dir)), "documents")
    return mix(sizes).apply(sizes).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "rate")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = language_id(docs, model, keep=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", F.array_join("found.langs", ",").alias("langs"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), Alike(words=4, num=85, den=100)).withColumnRenamed("id", "doc_id")


OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED_RE}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_ AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_ ON least_.a = w.doc_id
"""


def op8_decontamination(spark: SparkSession, sf_dir: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"], block_bytes=block_bytes)
    return found.select("row.doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


OP8_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_RE}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_RE}') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM i WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, lengths WHERE len(ws) >= n)),
hits AS (SELECT doc_id, p, places.n AS n, item_id FROM places JOIN windows ON places.gram = windows.gram AND places.n = windows.n),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def decontamination_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op8 with the benchmark as a table, which it is where it's larger than what workers hold."""
    return op8_decontamination(spark, sf_dir, block_bytes=0)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(chat_format(rows.unionByName(probe)))


OP10_SQL = rf"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + {len(TURN + TEXT + END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", moved.alias("label"))
    found = hard_negatives(rows, F.col("id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_VECTORS_SQL = """
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_PRODUCT_SQL = "CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT)"

OP11_SQL = f"""
WITH {_VECTORS_SQL},
x AS (SELECT * FROM r WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, {_PRODUCT_SQL} AS score FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5
"""


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP12_SQL = f"""
WITH {_VECTORS_SQL},
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_PRODUCT_SQL} AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


def document_changes(docs: DataFrame) -> DataFrame:
    """Two changes of every document: concerned, kind, since, until, value, and what they arrive by: h, doc_id, j."""
    digest = F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("j").cast("string")), 256), 1, 12)
    rows = docs.where("doc_id is not null").select("doc_id", "source", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    rows = rows.withColumn("h", F.conv(digest, 16, 10).cast("long"))
    kind, since = F.floor(F.col("h") / 1000) % 10, F.col("h") % 60
    named = F.when(kind < 2, "delete").when(kind < 5, "correction").otherwise("update")
    return rows.select((F.col("doc_id") - F.col("doc_id") % 10).alias("concerned"), named.alias("kind"), since.alias("since"), F.when(kind.between(2, 4), since + 10).alias("until"), F.col("source").alias("value"), "h", "doc_id", "j")


def op13_dimension_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = document_changes(documents(spark, sf_dir).select("doc_id", "source"))
    return history(changes, key="concerned", arrival=("h", "doc_id", "j"), span=SPAN).withColumnRenamed("key", "doc_id")


OP13_SQL = """
WITH j AS (SELECT doc_id, source, unnest([0, 1]) AS j FROM documents WHERE doc_id IS NOT NULL),
h AS (SELECT *, CAST(concat('0x', substr(sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 12)) AS BIGINT) AS h FROM j),
c AS (SELECT doc_id - doc_id % 10 AS key, row_number() OVER (ORDER BY h, doc_id, j) AS arrived, h % 60 AS since, (h // 1000) % 10 AS kind, source FROM h),
days AS (SELECT key, unnest(range(0, 71)) AS day FROM (SELECT DISTINCT key FROM c)),
fixed AS (SELECT d.key, day, max(arrived) AS arrived FROM days d JOIN c ON c.key = d.key AND kind BETWEEN 2 AND 4 AND day >= since AND day < since + 10 GROUP BY d.key, day),
base AS (SELECT d.key, day, max_by(arrived, (since, arrived)) AS arrived FROM days d JOIN c ON c.key = d.key AND kind NOT BETWEEN 2 AND 4 AND day >= since GROUP BY d.key, day),
state AS (SELECT d.key, d.day, c.source AS value, kind >= 2 AS present FROM days d LEFT JOIN fixed USING (key, day) LEFT JOIN base ON base.key = d.key AND base.day = d.day
  LEFT JOIN c ON c.arrived = coalesce(fixed.arrived, base.arrived)),
held AS (SELECT key, day, value, day - row_number() OVER (PARTITION BY key, value ORDER BY day) AS island FROM state WHERE present),
runs AS (SELECT key, value, min(day) AS valid_from, max(day) + 1 AS ends FROM held GROUP BY key, value, island)
SELECT key AS doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY valid_from) AS INTEGER) AS version, valid_from, CASE WHEN ends <= 70 THEN ends END AS valid_to, value FROM runs
"""


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1, what SQL can say."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_BASE_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_RE}') AS ws FROM documents),
p AS (SELECT doc_id, ws, list_filter(range(1, len(ws)), lambda i: ws[i] = 'mit' AND ws[i + 1] = 'license') AS mit,
  list_filter(range(1, len(ws)), lambda i: ws[i] = 'apache' AND ws[i + 1] = 'license') AS apache,
  list_filter(range(1, len(ws) - 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS gpl FROM w),
a AS (SELECT *, list_concat(mit, list_concat(apache, gpl)) AS every FROM p)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) - 1 AS BIGINT) AS first_word, CAST(list_max(every) - 1 AS BIGINT) AS last_word,
  array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels
FROM a
"""


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2, what its law says of each shard: rows, and slots from 0 without a gap."""
    out = op2_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots"))
    return out.select(F.col("shard").cast("long").alias("shard"), "n", "low", "high", "slots")


SHARD_COUNTS_SQL = """
WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(0, 24)) AS shard),
c AS (SELECT CAST(shard AS BIGINT) AS shard, CAST(n // 24 + CASE WHEN shard < n % 24 THEN 1 ELSE 0 END AS BIGINT) AS n FROM s, n)
SELECT shard, n, CAST(0 AS BIGINT) AS low, n - 1 AS high, n AS slots FROM c WHERE n > 0
"""


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_sharding(spark, sf_dir).select("doc_id", "size", "law", "grown_shard")


SHARD_SIZES_SQL = "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, 'rows' AS law, CAST(NULL AS INTEGER) AS grown_shard FROM documents"


def sharding_by_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op2 with edges: each document is linked to the least id of its near copies (five words, 0.8). cut: whether the two are in
    different shards; hash_cut: whether dealing by the text's hash, which keeps equal texts together too, would part them.
    Both are null without a link. Of rows that repeat an id, the smallest link, shard and hash stand for it."""
    docs = documents(spark, sf_dir)
    links = stash(ngram_join(docs, Alike(words=5, num=80, den=100)).where("id <> component_id").groupBy(F.col("id").alias("a")).agg(F.min("component_id").alias("b")), "links")
    dealt = stash(shard_documents(docs, shards=24, edges=links.withColumn("w", F.lit(1).cast("long"))), "dealt").withColumn("by_hash", (F.col("text_crc32") % 24).cast("int"))
    ends = dealt.where("id is not null").groupBy(F.col("id").alias("b")).agg(F.min("shard").alias("b_shard"), F.min("by_hash").alias("b_hash"))
    known = links.join(ends, "b").select(F.col("a").alias("id"), F.col("b").alias("linked_to"), "b_shard", "b_hash")
    out = dealt.join(known, "id", "left")
    return out.select(F.col("id").alias("doc_id"), "linked_to", "shard", "slot", (F.col("shard") != F.col("b_shard")).alias("cut"), (F.col("by_hash") != F.col("b_hash")).alias("hash_cut"))


def _crc32(digits: str) -> str:
    """DuckDB's SQL for the CRC-32 of a string of ASCII characters: a fold over its bytes, eight shifts after each."""
    steps = f"flatten(list_transform(string_split({digits}, ''), lambda ch: list_prepend(CAST(ascii(ch) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))"
    fold = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: CASE WHEN x < 0 THEN xor(c >> 1, (c & 1) * 3988292384) ELSE xor(c, x) END)"
    return f"xor({fold}, 4294967295)"


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3, what SQL can say."""
    return op3_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


LM_BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 2, false) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED_RE}'), '') AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))), 5) AS base_score
FROM t LEFT JOIN c ON t.w = c.w, n GROUP BY doc_id, held_out, n, v
"""


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4, what SQL can say."""
    return op4_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


TOKEN_BYTES_SQL = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents"


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5, what SQL can say."""
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("bounded"))


MIX_TARGETS_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED_RE}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size AS cap, sum(source_size) OVER () * 1.5 AS words, sum(weight) OVER () AS weights FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS full_cap, coalesce(sum(weight) OVER before, 0) AS full_weight FROM r WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / weight <= (words - full_cap) / (weights - full_weight) AS stops FROM o),
l AS (SELECT (max(words) - coalesce(sum(cap) FILTER (stops), 0)) / nullif(max(weights) - coalesce(sum(weight) FILTER (stops), 0), 0) AS level FROM f)
SELECT doc_id, size, source_size, round(CAST(CASE WHEN stops THEN cap ELSE weight * level END AS DOUBLE), 4) AS target, true AS bounded
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source, l
"""


def language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6, what SQL can say."""
    return op6_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("und"))


LANGUAGE_SPLIT_SQL = f"""SELECT doc_id, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 4 = 2, false) AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS und FROM documents"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scan, op2_sharding, op3_lm_scoring, op4_token_counts, op5_mixing, op6_language_id, op7_ngram_join, op8_decontamination, op9_exact_dedup, op10_chat_format, op11_hard_negatives, op12_topk_search, op13_dimension_history)
    own += (license_base, shard_counts, shard_sizes, lm_base, token_bytes, mix_targets, language_split, decontamination_by_join, sharding_by_links)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_join": OP7_SQL, "op8_decontamination": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_topk_search": OP12_SQL, "op13_dimension_history": OP13_SQL} | {
        "license_base": LICENSE_BASE_SQL, "shard_counts": SHARD_COUNTS_SQL, "shard_sizes": SHARD_SIZES_SQL, "lm_base": LM_BASE_SQL, "token_bytes": TOKEN_BYTES_SQL, "mix_targets": MIX_TARGETS_SQL, "language_split": LANGUAGE_SPLIT_SQL, "decontamination_by_join": OP8_SQL,
    }
