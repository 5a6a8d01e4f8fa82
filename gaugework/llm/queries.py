"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import common
from gaugework.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.token_counts import token_counts

    # A cache of its own for each run, so that every run does the whole work.
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), common.scratch_path(spark, "token-cache"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.span_dedup import drop_repeated_spans

    return drop_repeated_spans(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.decontaminate import contaminated_pairs

    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.line_dedup import drop_frequent_lines

    kept = drop_frequent_lines(table(spark, sf_dir, "documents"), least=10, shortest=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.token_files import read_documents, write_token_files

    folder = common.scratch_path(spark, "token-files")
    return read_documents(write_token_files(table(spark, sf_dir, "documents"), folder, _tokenizer("word_bpe_49k.json"), end_id=1))


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0).drop("ids")


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.ball_tree import cluster

    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, prefix="3:")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.chat_format import digests, format_paths, numbered

    said = F.lit("\\### Assistant: </turn> ok")
    turn = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    probe = spark.range(1).select(F.lit(-7).alias("conv_id"), turn.alias("t")).select("conv_id", "t.turn", "t.role", said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    # Written once: the joins of keys read no texts.
    messages = common.materialize(numbered(turns), "chat-messages")
    return digests(common.materialize(format_paths(messages, branches=1), "chat-formatted"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP7 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP8 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""




def _op11(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """k-means, one pair of common tables a round: the distances of all vectors to all centroids, then the new centroids."""
    square = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT".format(d=dims)
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v AS c FROM v ORDER BY sha256('3:' || vec_id), v LIMIT {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, min((d, k)) AS best FROM (SELECT r, vec_id, v, k, {square} AS d FROM v, c{i}) GROUP BY r, vec_id, v)")
        if i < rounds:
            steps.append(
                f"m{i} AS (SELECT k, j, (s - ((s % n) + n) % n) // n AS x FROM (SELECT best[2] AS k, j, sum(v[j])::HUGEINT AS s, count(*) AS n "
                f"FROM a{i}, (SELECT unnest(range(1, {dims} + 1)) AS j) GROUP BY 1, 2))"
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(any_value(l.c), any_value(c{i}.c)) AS c FROM c{i} LEFT JOIN (SELECT k, list(x::BIGINT ORDER BY j) AS c FROM m{i} GROUP BY k) l ON l.k = c{i}.k GROUP BY c{i}.k)")
    return (
        f"WITH {', '.join(steps)}, f AS (SELECT vec_id, best[1] AS distance, best[2] AS k FROM a{rounds}) "
        "SELECT vec_id, f.k::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} USING (k)"
    )


_OP12 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(i, r)),
e AS (SELECT *, '<turn ' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>'
  || regexp_replace(text, '(</?\\*)turn', '\1\\turn', 'g') || '</turn>' || chr(10) AS piece FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(piece))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 10 * length(d.text))::INT
    + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first_id, false)::INT AS mask
  FROM d JOIN s ON s.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x)
  JOIN x e ON e.x NOT IN (a.x, b.x, c.x) JOIN x g ON g.x NOT IN (a.x, b.x, c.x, e.x)),
p AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS prior FROM o, (SELECT unnest(range(1, 6)) AS step)),
b AS (
  SELECT *, (1 << (instr('ABCDE', letter) - 1)) AS own,
    coalesce(list_sum(list_transform(list_filter(string_split(prior, ''), lambda y: y <> ''), lambda y: 1 << (instr('ABCDE', y) - 1))), 0)::INT AS earlier FROM p),
r AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, b GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": _OP7, "op8_line_dedup": _OP8, "op11_ball_tree_clusters": _op11(), "op12_chat_format": _OP12, "op13_filter_audit": _OP13}
