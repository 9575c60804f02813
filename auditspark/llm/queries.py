"""Registered queries of the training-data operators and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroid_orchard,
    conversation_trie,
    decontaminate,
    embedding_dedup,
    language_id,
    line_spread,
    minimax_shards,
    mixture,
    piece_encoding,
    simhash_pivot,
    suffix_dedup,
    token_files,
    weak_quality,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_simhash_near_dedup(spark, sf_dir):
    out = simhash_pivot.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))


@query
def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = weak_quality.fit(docs, table(spark, sf_dir, "labels"))
    out = weak_quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.col("_p_junk").alias("p_junk"), F.col("_p_toxic").alias("p_toxic"), F.col("_kept").alias("kept"))


@query
def op1_benchmark_decontamination(spark, sf_dir):
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op1_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(g) AS k, g FROM (
    SELECT item_id, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS t,
           least(10, len(w)) AS k0, string_split(t, ' ') AS g
    FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p,
         unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS t
  FROM d, ks WHERE len(w) >= k),
hit AS (SELECT r, p, k, item_id FROM dw JOIN (SELECT item_id, k AS bk, array_to_string(g, ' ') AS bt FROM bw) ON bk = k AND bt = t),
hw AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM (SELECT r, p, unnest(range(0, k)) AS o FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""


@query
def op2_sharding(spark, sf_dir):
    out = minimax_shards.shards(table(spark, sf_dir, "documents"), n_shards=16)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: target weights of the mixture query and of the pipeline; values that are not named weigh 1
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX_SEED = 7


def domain_of(source):
    """Domain of a source: its number modulo 4 (the tables name no domain); null
    without a number of 64 bits at its end."""
    return F.concat(F.lit("domain"), (F.regexp_extract(source, r"(\d+)$", 1).try_cast("long") % 4).cast("string"))


@query
def op4_mixing_to_target_weights(spark, sf_dir):
    out = mixture.mix(table(spark, sf_dir, "documents"), domain_of(F.col("source")), 0.6, MIX_WEIGHTS, 3, MIX_SEED)
    return out.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "epoch", "n_tokens", F.col("take").alias("take_tokens"))


def _mix_level(k: int) -> str:
    """One level of the budget tree: shares from the parent's budget ``g``."""
    path = ", ".join(mixture.LEVELS[: k + 1])
    level, parent = mixture.LEVELS[k], ", ".join(mixture.LEVELS[:k]) or "0"
    cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in MIX_WEIGHTS.get(level, {}).items())
    weight = f"CASE {level} {cases} ELSE 1 END" if cases else "1"
    given = (f"(SELECT * FROM b{k - 1})" if k else "(SELECT least(CAST(floor(sum(tokens) * CAST(0.6 AS DOUBLE)) AS BIGINT), sum(tokens) * 3) AS g FROM leaf)")
    join = f"JOIN {given} USING ({parent})" if k else f", {given}"
    return f"""
n{k} AS (SELECT * FROM (SELECT {path}, CAST(sum(tokens) * 3 AS HUGEINT) AS cap, CAST(any_value({weight}) AS HUGEINT) AS w FROM leaf GROUP BY {path}) {join}),
s{k} AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw FROM n{k}),
f{k} AS (SELECT *, cap * lw <= (g - before) * w AS filled FROM s{k}),
r{k} AS (SELECT *, g - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS rest,
  sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS ow FROM f{k}),
h{k} AS (SELECT *, CASE WHEN filled THEN cap ELSE (rest * w) // ow END AS share FROM r{k}),
o{k} AS (SELECT *, rest - sum(CASE WHEN filled THEN 0 ELSE share END) OVER (PARTITION BY {parent}) AS odd,
  sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (PARTITION BY {parent} ORDER BY {level} ROWS UNBOUNDED PRECEDING) AS nth FROM h{k}),
b{k} AS (SELECT {path}, CAST(share + CASE WHEN NOT filled AND nth <= odd THEN 1 ELSE 0 END AS HUGEINT) AS g FROM o{k})"""


ORACLE["op4_mixing_to_target_weights"] = rf"""
WITH t AS (
  SELECT doc_id, coalesce('domain' || (CAST(nullif(regexp_extract(source, '(\d+)$', 1), '') AS BIGINT) % 4), '(none)') AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')) AS n_tokens FROM documents),
docs AS (SELECT * FROM t WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL),{_mix_level(0)},{_mix_level(1)},{_mix_level(2)},
p AS (SELECT domain, lang, source, tokens, g // tokens AS whole, g % tokens AS rest FROM leaf JOIN b2 USING (domain, lang, source)),
k AS (SELECT docs.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('{MIX_SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS pos
      FROM docs JOIN p USING (domain, lang, source)),
e AS (SELECT *, unnest(range(0, CAST(whole + CASE WHEN pos < rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM k)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(CASE WHEN epoch < whole THEN n_tokens ELSE least(n_tokens, rest - pos) END AS BIGINT) AS take_tokens
FROM e
"""


@query
def op6_embedding_near_dedup(spark, sf_dir):
    out = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component")).alias("kept"))


ORACLE["op6_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
x AS (SELECT *, floor(log2(list_max(list_transform(e, lambda x: abs(x))))) AS p FROM v),
w AS (SELECT vec_id, label, list_transform(e, lambda x: x / power(2.0::DOUBLE, floor(p / 2)) / power(2.0::DOUBLE, p - floor(p / 2))) AS e FROM x),
n AS (SELECT *, list_inner_product(e, e) AS s FROM w),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(a.s * b.s) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""


@query
def op3_token_id_output(spark, sf_dir):
    import public_tokenizers
    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(manifest).withColumnRenamed("id", "doc_id")


@query
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"),
                      F.col("_score").alias("score"), F.col("_bits").alias("bits_per_char"), F.col("_rejected").alias("rejected"))


@query
def op8_line_dedup(spark, sf_dir):
    out = line_spread.remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=10)
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE["op8_line_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT r, source, unnest(a) AS raw, unnest(range(0, len(a))) AS i, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM d WHERE text IS NOT NULL),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
k AS (SELECT r, count(*) AS n_lines, count(b.line) AS n_removed,
             string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL) AS clean
      FROM l LEFT JOIN b USING (line) GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(clean, '')) AS text_sha256
FROM d LEFT JOIN k USING (r)
"""


@query
def op9_suffix_array_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_sentencepiece_encoding(spark, sf_dir):
    import public_tokenizers
    out = piece_encoding.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


@query
def op12_centroid_clustering(spark, sf_dir):
    out = centroid_orchard.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed="2")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                      F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _centroid_round(k: int) -> str:
    """Assignment to the centroids ``c<k-1>`` and their floored means, as ``c<k>``."""
    return f"""
a{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c FROM (
  SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - z.q[i]) * (v.q[i] - z.q[i]))) AS d FROM v, c{k - 1} z) GROUP BY r),
m{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
  SELECT c, i, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT r, unnest(q) AS x, unnest(range(0, 64)) AS i FROM v) JOIN a{k} USING (r) GROUP BY c, i) GROUP BY c),
c{k} AS MATERIALIZED (SELECT z.c, coalesce(m.q, z.q) AS q FROM c{k - 1} z LEFT JOIN m{k} m USING (c))"""


ORACLE["op12_centroid_clustering"] = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS q FROM e
  WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q FROM v
  QUALIFY c < 40),{",".join(_centroid_round(k) for k in range(1, 6))},
f AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - z.q[i]) * (v.q[i] - z.q[i]))) AS d FROM v, c5 z) GROUP BY r)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.q, ',')) AS centroid_sha256
FROM f JOIN v USING (r) JOIN c5 USING (c)
"""


@query
def op11_conversation_prefix_trie(spark, sf_dir):
    out = conversation_trie.trie(conversation_trie.rebuilt(table(spark, sf_dir, "conversations"), every=20, heads=4))
    return out.select(F.col("id").alias("conv_id"), "depth", F.col("parent_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      "saved_tokens", "ends_sha256")


ORACLE["op11_conversation_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS tid FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT DISTINCT tid, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
o AS (SELECT conv_id, list(tid ORDER BY turn NULLS FIRST, role, text) AS s FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, s, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])),
                             lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h FROM o),
r AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], CAST([] AS BIGINT[])), a.s[a.h + 1:]) AS s
      FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, len(s) AS l, unnest(range(0, len(s) + 1)) AS d, s FROM r),
n AS (SELECT s[1:d] AS k, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l = d) AS ends FROM p GROUP BY k),
c AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(words, 0) AS own
      FROM n LEFT JOIN c USING (k) LEFT JOIN w ON w.tid = n.k[n.d]),
u AS (SELECT k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
      FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u USING (k) LEFT JOIN n q ON m.d > 0 AND q.k = m.k[1:m.d - 1]
"""
