"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm import dimscan, filters, jaccard, language, lloyd, mtree, packing, quotes, repeats, secrets, sharding, tokens, toxicity
from sluicegate.llm.common import fold, read


def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs, train_rows=fold("doc_id", 4) != 2)
    return language.identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    # floor makes integers of NaN and infinity, so these become null first, which valid_rows leaves out
    whole = F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(256 * x.cast("double"))))
    return mtree.top_k(rows.select("vec_id", whole.alias("embedding")), k=5, every=50)


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, ledger = secrets.scan(read(spark, sf_dir, "documents"))
    found = secrets.by_path(versions, ledger)
    base = [r.kind for r in secrets.RULES[:3]]
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(base)]
    joined = secrets.span_text(F.col("spans"))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"), n_shards=8, keep=[])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimscan.nearest(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(read(spark, sf_dir, "conversations"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), n=5, percent=80)


def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), train_rows=fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, with_ratio=False).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.main_text(read(spark, sf_dir, "pages"))


def op12_relational_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(filters.flags(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op13_plain_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, size=64, salt=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ppm_language, op2_mtree_top_k, op3_secret_ledger, op4_best_fit_packing, op5_byte_bpe, op6_histogram_shards, op7_adaptive_scan, op8_quotation_linking, op9_ngram_jaccard, op10_kneser_ney_toxicity, op11_host_suffix_array, op12_relational_replay, op13_plain_lloyd)}


#: Products in doubles are exact below 2 ** 53.
_OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op3_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    rules = secrets.RULES[:3]
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, string_split_regex(t, {quoted(r.pattern)}) AS b, regexp_extract_all(t, {quoted(r.pattern)}) AS w, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g, {r.least} AS least FROM d" for k, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(rules))
    names = "[" + ", ".join(quoted(r.kind) for r in rules) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({found}),
p AS (SELECT doc_id, k, least, unnest([{{'a': coalesce(list_sum([length(x) FOR x IN b[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN w[1:i - 1]]), 0), 'n': length(w[i]), 'c': length(g[i])}} FOR i IN range(1, len(w) + 1)]) AS s FROM m WHERE len(w) > 0),
f AS (SELECT doc_id, k, CAST(s.a AS BIGINT) AS a, CAST(s.a + s.n AS BIGINT) AS z FROM p WHERE s.c >= least),
r AS (SELECT doc_id, {counts}, string_agg({names}[k + 1] || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


_OP9_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * k >= 80 * (na + nb - k) UNION ALL SELECT b, a FROM c WHERE 100 * k >= 80 * (na + nb - k)),
reach(item, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.item, e.b FROM reach JOIN e ON reach.other = e.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(other) FROM reach WHERE item = doc_id) AS component_id FROM sets
"""


_OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN firsts USING (t) LEFT JOIN told ON d.doc_id = told.doc_id),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(string_split('ABCDE', '')) AS x),
orders AS (SELECT a.x || b.x || c.x || e.x || h.x AS filter_order FROM l a, l b, l c, l e, l h WHERE len(list_distinct([a.x, b.x, c.x, e.x, h.x])) = 5),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, fails, good, toxic, n, fails[strpos('ABCDE', substr(filter_order, step, 1))] AS failing,
  coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: fails[strpos('ABCDE', substr(filter_order, k, 1))])), 6) AS first FROM g, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, sum(n * CAST(first > step AS INT)) AS kept, sum(n * CAST(first = step AS INT)) AS removed, sum(n * CAST(failing AND first < step AS INT)) AS redundant,
  sum(n * CAST(failing AND len(list_filter(fails, lambda x: x)) = 1 AS INT)) AS unique_fails, sum(n * CAST(first = step AND good AS INT)) AS good_lost, sum(n * CAST(first = step AND toxic AS INT)) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""


def _op13_sql(k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, salt: int = 3) -> str:
    """Rounds as chained tables; quotients of sums below 2 ** 53 floor rightly in doubles."""
    near = lambda c, more: f"SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.e) AS e, min_by({c}.c, [d, {c}.c]) AS c{more} FROM (SELECT v.r, {c}.c, CAST(list_sum(list_transform(list_zip(v.e, {c}.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, {c}) JOIN v USING (r) JOIN {c} USING (c) GROUP BY r"
    steps = [f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({scale} * x) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"]
    steps.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), e) - 1 AS c, e FROM v QUALIFY c < {k})")
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near(f'c{n}', '')})")
        steps.append(f"m{n} AS MATERIALIZED (SELECT c, list(m ORDER BY p) AS e FROM (SELECT c, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM a{n}) GROUP BY c, p) GROUP BY c)")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.e, c{n}.e) AS e FROM c{n} LEFT JOIN m{n} USING (c))")
    steps.append(f"z AS ({near(f'c{rounds}', ', min(d) AS distance')})")
    text = f"SELECT c, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM c{rounds}"
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM z JOIN ({text}) USING (c)"


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can express: not the byte models, the tokenizers, hashes of the engine's own, or approximate search."""
    return {"op2_mtree_top_k": _OP2_SQL, "op3_secret_ledger": _op3_sql(), "op9_ngram_jaccard": _OP9_SQL, "op12_relational_replay": _OP12_SQL, "op13_plain_lloyd": _op13_sql()}
