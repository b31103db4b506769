"""Registered queries of this package; they derive the columns asked for from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import chat, decontam, embedding_dedup, line_dedup, maxent, negatives, ngram_join, perplexity, pieces, pii, quality, repair, sharding
from lineloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Labelled documents the classifier is fitted on, at most.
LABELLED_ROWS = 20_000


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def remainder(id: str, of: int = 5):
    """crc32 of the id written as text, modulo ``of``; a null id has none."""
    return F.crc32(F.encode(F.col(id).cast("string"), "UTF-8")) % of


@query
def op1_line_edit_join(spark, path):
    return line_dedup.classify(table(spark, path, "documents")).drop("text_hash")


@query
def op2_pieces(spark, path):
    rows = pieces.encode_checked(table(spark, path, "documents").select("doc_id", "text"), pieces.load())
    return rows.select("doc_id", F.size("pieces").alias("n_pieces"), F.octet_length("text").alias("n_bytes"), "round_trip", "pieces")


@query
def op3_vertical_join(spark, path):
    linked = ngram_join.link(table(spark, path, "documents"), 3, Fraction(9, 10))
    return linked.select("doc_id", "n_shingles", "component_id")


@query
def op4_virtual_slots(spark, path):
    placed = sharding.shard_and_grow(table(spark, path, "documents"), 40, scratch_path(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")


@query
def op5_latent_decontamination(spark, path):
    hits = decontam.contaminated(table(spark, path, "documents"), table(spark, path, "benchmark"))
    return hits.select("doc_id", "item_id", "cosine", "common", "answered")


@query
def op6_nn_descent(spark, path):
    return embedding_dedup.link(table(spark, path, "embeddings"))


@query
def op7_maxent(spark, path):
    docs = table(spark, path, "documents")
    model, counts = maxent.fit(docs.filter(remainder("doc_id") != 1))
    held_out = F.coalesce(remainder("doc_id") == 1, F.lit(True)).alias("held_out")
    return maxent.score(docs, model, counts, keep=["doc_id", held_out])


@query
def op8_pii(spark, path):
    found = pii.find_pii(table(spark, path, "documents"))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *(count(k) for k in pii.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"),
                        pii.joined(F.col("pii")).alias("spans"), F.transform("pii", lambda x: x["score"]).alias("scores"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted on rows whose remainder is not 0."""
    seen = labels.filter(remainder("doc_id") != 0)
    return quality.fit(quality.sample(docs, seen, LABELLED_ROWS))


@query
def op9_tool_links(spark, path):
    return chat.link(*chat.from_turns(table(spark, path, "conversations")))


SQL["op9_tool_links"] = """
WITH u AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY ALL),
a AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL),
n AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM u)
SELECT n.conv_id || '-' || n.turn AS id, 'respond' AS name,
       row_number() OVER (PARTITION BY n.conv_id, n.turn % 2, n.run ORDER BY n.turn) - 1 AS level,
       a.turn IS NOT NULL AS linked, n.text IS NOT NULL AS valid,
       CASE WHEN n.text IS NULL THEN ['missing:prompt'] ELSE []::VARCHAR[] END AS problems,
       '{"arguments":{' || CASE WHEN n.text IS NULL THEN '' ELSE '"prompt":' || to_json(n.text)::VARCHAR || ',' END || '"turn":' || n.turn
       || '},"id":"' || n.conv_id || '-' || n.turn || '","name":"respond"'
       || CASE WHEN a.text IS NULL THEN '' ELSE ',"result":' || to_json(a.text)::VARCHAR END || '}' AS message
FROM n LEFT JOIN a ON a.conv_id = n.conv_id AND a.turn = n.turn + 1
"""


@query
def op10_factorisation(spark, path):
    docs = table(spark, path, "documents")
    model = quality_model(docs, table(spark, path, "labels"))
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(True)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op11_windowed_negatives(spark, path):
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = negatives.quantised(table(spark, path, "embeddings"), "vec_id", moved, "embedding")
    return negatives.mine(rows, F.col("id") % 100 == 0)


SQL["op11_windowed_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positive AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM pair WHERE same),
found AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank,
         n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
  WHERE place <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""


@query
def op12_perplexity_bands(spark, path):
    judged = perplexity.judge(table(spark, path, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", *perplexity.MEASURES, F.round("log10_perplexity", 4).alias("log10_perplexity"), "base_failed", "kept")


SQL["op12_perplexity_bands"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM often, range(3) t(k) GROUP BY r),
base AS (
  SELECT d.r, doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d) d LEFT JOIN repeated USING (r)),
symbol AS (
  SELECT r, [chr(2), chr(2), chr(2), chr(2)] || CASE WHEN len(ws) = 0 THEN [] ELSE string_split(array_to_string(ws, ' '), '') END || [chr(3)] AS s FROM d),
gram AS (SELECT r, s[i] || s[i + 1] || s[i + 2] || s[i + 3] || s[i + 4] AS g FROM (SELECT r, s, unnest(range(1, len(s) - 3)) AS i FROM symbol)),
c5 AS MATERIALIZED (SELECT g, count(*) AS c FROM gram GROUP BY g),
c4 AS MATERIALIZED (SELECT substr(g, 2) AS g, count(*) AS c FROM c5 GROUP BY 1),
c3 AS MATERIALIZED (SELECT substr(g, 2) AS g, count(*) AS c FROM c4 GROUP BY 1),
c2 AS MATERIALIZED (SELECT substr(g, 2) AS g, count(*) AS c FROM c3 GROUP BY 1),
c1 AS MATERIALIZED (SELECT substr(g, 2) AS g, count(*) AS c FROM c2 GROUP BY 1),
counts AS MATERIALIZED (SELECT 1 AS k, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3 UNION ALL SELECT 4, * FROM c4 UNION ALL SELECT 5, * FROM c5),
n AS (SELECT k, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM counts GROUP BY k),
guess AS (SELECT k, n1 * n2 * n3 * n4 > 0 AS fine, 1 - 2 * y * n2 / n1 AS d1, 2 - 3 * y * n3 / n2 AS d2, 3 - 4 * y * n4 / n3 AS d3 FROM (SELECT *, n1 / (n1 + 2 * n2) AS y FROM n)),
disc AS (SELECT k, CASE WHEN ok THEN d1 ELSE 0.5 END AS d1, CASE WHEN ok THEN d2 ELSE 1 END AS d2, CASE WHEN ok THEN d3 ELSE 1.5 END AS d3
         FROM (SELECT *, coalesce(fine AND d1 > 0 AND d1 < 1 AND d2 > 0 AND d2 < 2 AND d3 > 0 AND d3 < 3, FALSE) AS ok FROM guess)),
less AS MATERIALIZED (SELECT k, g, left(g, k - 1) AS context, c, CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d FROM counts JOIN disc USING (k)),
free AS MATERIALIZED (SELECT k, context, sum(c) AS total, sum(d) / sum(c) AS w FROM less GROUP BY ALL),
own AS MATERIALIZED (SELECT k, g, (c - d) / total AS p, w FROM less JOIN free USING (k, context)),
p1 AS (SELECT g, p + w / ((SELECT count(*) FROM c1) + 1) AS p FROM own WHERE k = 1),
p2 AS (SELECT o.g, o.p + w * s.p AS p FROM own o JOIN p1 s ON s.g = substr(o.g, 2) WHERE k = 2),
p3 AS (SELECT o.g, o.p + w * s.p AS p FROM own o JOIN p2 s ON s.g = substr(o.g, 2) WHERE k = 3),
p4 AS (SELECT o.g, o.p + w * s.p AS p FROM own o JOIN p3 s ON s.g = substr(o.g, 2) WHERE k = 4),
p5 AS (SELECT o.g, o.p + w * s.p AS p FROM own o JOIN p4 s ON s.g = substr(o.g, 2) WHERE k = 5),
scored AS MATERIALIZED (
  SELECT base.*, x AS log10_perplexity, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM base JOIN (SELECT r, -sum(log10(p)) / count(*) AS x FROM gram JOIN p5 USING (g) GROUP BY r) USING (r)),
bins AS (SELECT lang, floor(log10_perplexity * 1000) AS bin, count(*) AS n FROM scored WHERE NOT base_failed GROUP BY ALL),
upto AS (SELECT lang, bin, sum(n) OVER (PARTITION BY lang ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang) AS total FROM bins),
quarter AS (SELECT lang, min(bin) FILTER (upto >= total * 0.25) / 1000 AS a, min(bin) FILTER (upto >= total * 0.75) / 1000 AS b FROM upto GROUP BY lang),
band AS (SELECT lang, a - greatest(b - a, 0.01) * 4 AS low, b + greatest(b - a, 0.01) * 4 AS high FROM quarter)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(log10_perplexity, 4) AS log10_perplexity, base_failed,
       coalesce(NOT base_failed AND log10_perplexity BETWEEN low AND high, FALSE) AS kept
FROM scored LEFT JOIN band ON band.lang IS NOT DISTINCT FROM scored.lang
"""


@query
def op13_checkpointed_repair(spark, path):
    rows = table(spark, path, "conversations")
    fixed = repair.repair(repair.damage(rows))
    hashed = repair.digests(fixed.rows).withColumnRenamed("conv_id", "_id")
    every = rows.select("conv_id").distinct().unionByName(fixed.report, allowMissingColumns=True).groupBy("conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = every.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    hashed = found.join(hashed, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return hashed.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


SQL["op13_checkpointed_repair"] = r"""
WITH RECURSIVE bits AS (
  SELECT list(v ORDER BY b) AS tbl FROM (
    SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(b))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
                                  lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, bits),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM hurt),
faulty AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS now, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || now NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
-- states: z nothing yet, s system, u user, a assistant; each with its cheapest, ASCII-least way there
walk AS (
  SELECT conv_id, n, 0::BIGINT AS i, [{'c': 0, 'e': '', 't': ''}] AS z, []::STRUCT(c INTEGER, e VARCHAR, t VARCHAR)[] AS s,
         [{'c': 5, 'e': 'I', 't': E'user:\n'}] AS u, [{'c': 10, 'e': 'II', 't': E'user:\nassistant:\n'}] AS a FROM stats
  UNION ALL
  SELECT conv_id, n, i, z, s, list_sort(u || list_transform(list_sort(a)[:1] || z || s, lambda x: {'c': x.c + 5, 'e': x.e || 'I', 't': x.t || E'user:\n'}))[:1] AS u,
         list_sort(a || list_transform(list_sort(u || list_transform(z || s, lambda x: {'c': x.c + 5, 'e': x.e || 'I', 't': x.t || E'user:\n'}))[:1],
                                       lambda x: {'c': x.c + 5, 'e': x.e || 'I', 't': x.t || E'assistant:\n'}))[:1] AS a
  FROM (
    SELECT w.conv_id, n, f.i,
      list_transform(z, lambda x: {'c': x.c + 2, 'e': x.e || 'D', 't': x.t}) AS z,
      list_sort(list_transform(s, lambda x: {'c': x.c + 2, 'e': x.e || 'D', 't': x.t}) || CASE WHEN stays AND now = 's' THEN list_transform(z, lambda x: {'c': x.c + more, 'e': x.e || 'K', 't': x.t || line}) ELSE [] END)[:1] AS s,
      list_sort(list_transform(u, lambda x: {'c': x.c + 2, 'e': x.e || 'D', 't': x.t})
                || CASE WHEN stays AND now = 'u' THEN list_transform(z || s || a, lambda x: {'c': x.c + more, 'e': x.e || 'K', 't': x.t || line}) ELSE [] END
                || CASE WHEN stays THEN list_transform(z || s || a, lambda x: {'c': x.c + more + 1, 'e': x.e || 'R', 't': x.t || 'user:' || text || E'\n'}) ELSE [] END)[:1] AS u,
      list_sort(list_transform(a, lambda x: {'c': x.c + 2, 'e': x.e || 'D', 't': x.t})
                || CASE WHEN stays AND now = 'a' THEN list_transform(u, lambda x: {'c': x.c + more, 'e': x.e || 'K', 't': x.t || line}) ELSE [] END
                || CASE WHEN stays THEN list_transform(u, lambda x: {'c': x.c + more + 1, 'e': x.e || 'R', 't': x.t || 'assistant:' || text || E'\n'}) ELSE [] END)[:1] AS a
    FROM walk w JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more, role || ':' || text || E'\n' AS line FROM faulty) f
      ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
best AS (SELECT conv_id, list_sort(z || a)[1] AS b FROM walk WHERE i = n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(regexp_replace(b.t, '\n\z', ''), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""
