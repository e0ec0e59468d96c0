"""The corpus operators as queries over the tables of a folder, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_knn, toxicity
from .chat import chat_digests, chat_windows, written
from .decontaminate import find_leaks
from .features import bounded_keys, fold_of
from .importance import importance
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import ngram_components
from .quality_rules import quality_rules
from .repair import damaged, repair
from .session import checkpointed
from .substring_dedup import substring_dedup
from .warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES["op1_substring_dedup"] = op1_substring_dedup
ORACLES["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, j, w[j] AS word, CASE WHEN j + 34 <= len(w) THEN md5(array_to_string(w[j : j + 34], ' ')) END AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
c AS (SELECT doc_id, j, word, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS again FROM g),
k AS (SELECT doc_id, j, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
t AS (SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.col("m").alias("n_item_shingles"), F.col("shared").alias("n_shared"))


QUERIES["op2_decontamination"] = op2_decontamination
ORACLES["op2_decontamination"] = r"""
WITH d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item_id, least(len(w), 5) AS k, unnest(list_distinct(list_transform(range(0, len(w) - least(len(w), 5) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 5)], ' ')))) AS s FROM b WHERE len(w) > 0),
m AS (SELECT item_id, CAST(count(*) AS BIGINT) AS m FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM d WHERE len(w) >= 5)
SELECT doc_id, item_id, m AS n_item_shingles, CAST(count(*) AS BIGINT) AS n_shared
FROM ds JOIN bs USING (s) JOIN m USING (item_id)
GROUP BY doc_id, item_id, m HAVING 100 * count(*) >= 75 * m
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES["op3_ngram_jaccard"] = op3_ngram_jaccard
ORACLES["op3_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END)) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY doc_id),
often AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
o AS (SELECT s.doc_id, s.s FROM s JOIN often USING (s)),
may AS (SELECT o.doc_id FROM o JOIN n USING (doc_id) GROUP BY o.doc_id, n HAVING 100 * count(*) >= 75 * n),
p AS (SELECT o.doc_id, o.s FROM o JOIN may USING (doc_id)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op5_mixing"] = op5_mixing
ORACLES["op5_mixing"] = r"""
WITH z AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
y AS (SELECT *, md5(concat('mix|', CAST(doc_id AS VARCHAR), '|', CAST(size AS VARCHAR))) AS draw FROM z),
s AS (SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM z GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (no - 1) % 3] AS w FROM s),
b AS (SELECT *, sum(source_size) OVER () AS every, sum(w) OVER () AS every_w, coalesce(sum(3 * source_size) OVER o, 0) AS gone, coalesce(sum(w) OVER o, 0) AS gone_w FROM w WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CAST(every - gone AS DOUBLE) / CAST(every_w - gone_w AS DOUBLE) AS rate FROM b),
t AS (SELECT source, no, docs, source_size, CAST(every // 16 AS BIGINT) AS blocks, least(CAST(3 * source_size AS DOUBLE), (SELECT arg_min(rate, gone_w) FROM r WHERE 3 * source_size >= rate * w) * w) AS target FROM r),
q AS (SELECT no, blocks, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no) AS nth FROM (SELECT no, blocks, target, unnest(range(0, blocks + 1)) AS k FROM t) WHERE target > 0),
n AS (SELECT t.*, CAST(coalesce(seats, 0) AS BIGINT) AS seats, CAST(ceil(docs / 10000) AS BIGINT) AS shards FROM t LEFT JOIN (SELECT no, count(*) AS seats FROM q WHERE nth <= blocks GROUP BY no) USING (no)),
d AS (SELECT y.*, n.no, n.source_size, n.target, n.seats, CAST(concat('0x', substr(draw, 1, 8)) AS BIGINT) % shards AS shard FROM y JOIN n ON n.source IS NOT DISTINCT FROM y.source),
c AS (SELECT no, shard, any_value(seats) AS seats, CAST(sum(size) AS BIGINT) AS cell FROM d GROUP BY no, shard),
p AS (SELECT no, shard, seats, row_number() OVER (PARTITION BY no ORDER BY cell / CAST(2 * k + 1 AS DOUBLE) DESC, shard) AS nth FROM (SELECT no, shard, seats, cell, unnest(range(0, seats + 1)) AS k FROM c) WHERE cell > 0),
l AS (SELECT c.no, c.shard, cell, 16 * coalesce(got, 0) AS words FROM c LEFT JOIN (SELECT no, shard, count(*) AS got FROM p WHERE nth <= seats GROUP BY no, shard) USING (no, shard)),
m AS (SELECT no, shard, cell, words, CASE WHEN cell > 0 THEN least(3, words // cell) ELSE 0 END AS rounds FROM l),
a AS (SELECT d.*, rounds, CASE WHEN rounds < 3 THEN words - rounds * cell ELSE 0 END AS rest, coalesce(sum(size) OVER (PARTITION BY no, shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN m USING (no, shard))
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM a
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op9_warc"] = op9_warc
ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS x FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(0, 32)], '') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op8_quality_rules"] = op8_quality_rules


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 3) == 1)
    model = language_id.fit(docs.where("not held_out"))
    return language_id.identify(docs, model, ["doc_id", "held_out"])


QUERIES["op4_language_id"] = op4_language_id


def _labelled(spark: SparkSession, sf_dir: str, label: str, per_label: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their fold, and a bounded sample of the labelled rows that may be learned from.

    Rows are drawn from the label table alone; their keys, 2 * per_label at
    most, are broadcast to the texts.
    """
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 4) == 2)
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("label"))
    drawn = checkpointed(bounded_keys(labels.where(fold_of(F.col("doc_id"), 4) != 2), "doc_id", "label", per_label, 2))
    return docs, checkpointed(docs.join(F.broadcast(drawn), "doc_id").select("label", "text"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, train = _labelled(spark, sf_dir, "quality", 1200)
    out = quality_knn.score_quality(docs, quality_knn.fit(train), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES["op6_quality_classifier"] = op6_quality_classifier


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, train = _labelled(spark, sf_dir, "toxic", 8000)
    out = toxicity.score_toxicity(docs, toxicity.fit(train, toxicity.char_model(docs)), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES["op10_toxicity"] = op10_toxicity


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = line_dedup(docs, ["doc_id"], long_words=50)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


QUERIES["op7_line_dedup"] = op7_line_dedup
ORACLES["op7_line_dedup"] = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
t AS (SELECT doc_id, i, j, n, line, lead(n, 1) OVER d AS n2, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
c AS (SELECT doc_id, i, j, n > 50 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, j) > 1 AS one, coalesce(n + n2 > 50, false) AND row_number() OVER (PARTITION BY line, l2 ORDER BY doc_id, j) > 1 AS two, l3 IS NOT NULL AND row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, j) > 1 AS three FROM t),
g AS (SELECT doc_id, i, j, one OR bool_or(two) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) OR bool_or(three) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM c),
r AS (SELECT doc_id, i, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS begins FROM g),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE NOT coalesce(gone, false)) AS kept, CAST(count(r.i) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE begins) AS BIGINT) AS n_runs FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.i = l.i GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of an expression's UTF-8 bytes: the first of eight steps of a byte adds it.
_CRC32 = r"""xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(0, CAST(octet_length(encode({0})) AS BIGINT)), lambda i: [CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))))"""

QUERIES["op11_importance"] = op11_importance
ORACLES["op11_importance"] = rf"""
WITH t AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM t),
g AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
k AS (SELECT g, {_CRC32.format("g")} % 10000 AS b FROM (SELECT DISTINCT g FROM g)),
f AS (SELECT side, r, b FROM g JOIN k USING (g)),
n AS (SELECT b, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS t FROM f GROUP BY b),
y AS (SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
m AS (SELECT r, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN y USING (b) WHERE side = 0 GROUP BY r),
h AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight, CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (r) WHERE side = 0),
x AS (SELECT doc_id, words, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS nth, count(*) FILTER (words >= 20) OVER () AS may FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND nth <= 25 * may // 100 THEN nth END AS rank FROM o
"""


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat_digests(written(chat_windows(rows.unionByName(own))))


QUERIES["op12_chat_windows"] = op12_chat_windows
#: Conversations of up to 1024 turns: one slice each.
ORACLES["op12_chat_windows"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)', '\1\\\2', 'g') AS body, regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)', '\1\\\2', 'g') AS name FROM t),
p AS (SELECT conv_id, turn, role, text, CASE role WHEN 'system' THEN '<<SYS>>' || chr(10) || body || chr(10) || '<</SYS>>' || chr(10) WHEN 'user' THEN '<s>[INST] ' || body || ' [/INST]' WHEN 'assistant' THEN ' ' || body || ' </s>' ELSE '[ROLE]' || name || '[INST] ' || body || ' [/ROLE]' END AS piece FROM e),
k AS (SELECT *, (octet_length(encode(piece)) + 3) // 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS nth FROM p),
h AS (SELECT *, nth = 1 AND role = 'system' AND tokens <= 512 AS head, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM k),
g AS (SELECT *, (2048 - 256 - max(CASE WHEN head THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)) // 2 AS cell FROM h),
a AS (SELECT *, coalesce(sum(CAST(tokens > cell AS INT)) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS alone FROM g),
s AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY 2 * alone + CAST(tokens > cell AS INT), CASE WHEN tokens > cell THEN 0 ELSE c // cell END) - 1 AS win FROM a),
w AS (SELECT *, max(win) OVER (PARTITION BY conv_id) AS last, max(c + tokens) OVER (PARTITION BY conv_id, win) AS over FROM s),
f AS (SELECT conv_id, CAST(sum(length(piece) * (1 + CASE WHEN head THEN last WHEN win < last AND over - c <= 256 THEN 1 ELSE 0 END)) AS BIGINT) AS formatted_chars FROM w GROUP BY conv_id),
d AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS turns, coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '') AS loss FROM k GROUP BY conv_id)
SELECT d.conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "conv")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _plus(path: str, cost: str, edit: str) -> str:
    """SQL for a path, ten digits of cost and the audit, with one edit more; '~' is no path."""
    return f"CASE WHEN {path} < '~' THEN lpad(CAST(CAST(substr({path}, 1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({path}, 11) || '{edit}' ELSE '~' END"


QUERIES["op13_conversation_repair"] = op13_conversation_repair
ORACLES["op13_conversation_repair"] = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
q AS (SELECT *, {_CRC32.format("name")} % 20 AS draw FROM o),
b AS (SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE draw WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM q WHERE draw <> 0),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS j, row_number() OVER (PARTITION BY conv_id, role, md5(text) ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM b),
m AS (SELECT conv_id, turn, j, role, text, substr(role, 1, 1) AS i, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated FROM l),
n AS (SELECT conv_id, count(*) AS rows, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM m GROUP BY conv_id),
i AS (SELECT conv_id, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY j) || i AS pair FROM m) GROUP BY conv_id),
x AS (
SELECT conv_id, 0 AS j, '0000000000' AS s0, '~' AS s1, '0000000003I' AS s2, '0000000006II' AS s3 FROM n
UNION ALL SELECT conv_id, j, t0, t1, u2, least(t3, {_plus("u2", "3", "I")}) FROM (
SELECT conv_id, j, t0, t1, t3, least(t2, {_plus("least(t0, t1, t3)", "3", "I")}) AS u2 FROM (
SELECT m.conv_id, m.j, {_plus("s0", "4", "D")} AS t0,
least({_plus("s1", "4", "D")}, CASE WHEN gone OR i <> 's' THEN '~' ELSE {_plus("s0", "more", "K")} END) AS t1,
least({_plus("s2", "4", "D")}, CASE WHEN gone THEN '~' WHEN i = 'u' THEN {_plus("least(s0, s1, s3)", "more", "K")} ELSE {_plus("least(s0, s1, s3)", "more + 3", "R")} END) AS t2,
least({_plus("s3", "4", "D")}, CASE WHEN gone THEN '~' WHEN i = 'a' THEN {_plus("s2", "more", "K")} ELSE {_plus("s2", "more + 3", "R")} END) AS t3
FROM x JOIN (SELECT *, blank OR duplicate AS gone, CASE WHEN truncated THEN 3 ELSE 0 END AS more FROM m) m ON m.conv_id IS NOT DISTINCT FROM x.conv_id AND m.j = x.j + 1))),
y AS (SELECT n.*, CAST(substr(least(s0, s3), 1, 10) AS BIGINT) AS cost, substr(least(s0, s3), 11) AS audit FROM n JOIN x ON x.conv_id IS NOT DISTINCT FROM n.conv_id AND x.j = n.rows),
c AS (SELECT conv_id, p, substr(audit, p, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM y)),
g AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS j, count(*) FILTER (edit <> 'D') OVER w AS e FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
h AS (SELECT g.conv_id, p, edit, e, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, bool_or(e = 1 AND edit = 'K' AND i = 's') OVER (PARTITION BY g.conv_id) AS sys FROM g LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM g.conv_id AND m.j = g.j),
z AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e % 2 = 1) = sys THEN 'assistant' ELSE 'user' END || ':' || text, chr(10) ORDER BY p) FILTER (edit <> 'D') AS said FROM h GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN i ON i.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
