"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import pii

    return pii.digest(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import lines

    docs = lines.drop_boilerplate(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP2_SQL = """
WITH cut AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), l AS (SELECT *, trim(raw, ' ') AS line FROM cut),
f AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 8),
o AS (SELECT l.* FROM l JOIN f USING (line)),
k AS (SELECT line, min({'d': doc_id, 'p': pos}) AS m FROM o GROUP BY line),
d AS (SELECT o.doc_id, o.pos FROM o JOIN k USING (line) WHERE NOT (o.doc_id = k.m.d AND o.pos = k.m.p)),
t AS (
  SELECT l.doc_id, count(*) FILTER (line <> '') AS n_lines, count(d.pos) AS n_dropped,
         coalesce(string_agg(raw, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL), '') AS t
  FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, length(t) AS n_chars, md5(t) AS text_md5 FROM t
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import mixing

    docs, _ = mixing.mix(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", "taken", "weight")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2, length=4096)


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import near_vectors

    return near_vectors.components(_table(spark, sf_dir, "embeddings"), limit=0.93)


def near_vectors_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every twentieth vector as op5 reports them and by comparing them with all rows of their label."""
    from photoflow.llm import near_vectors

    vectors = _table(spark, sf_dir, "embeddings")
    return near_vectors.audit(vectors, near_vectors.components(vectors, limit=0.93))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import token_files

    return token_files.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import licenses

    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import langid

    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import topk

    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR isnan(c) OR isinf(c)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.x, v.x)]) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.x) = len(q.x)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import jaccard

    return jaccard.components(_table(spark, sf_dir, "documents"), k=4, pct=85)


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)] ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
"""


def op11_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import heap_clusters

    return heap_clusters.digest(_table(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([c FOR c IN embedding IF c IS NULL OR isnan(c) OR isinf(c)]) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {k})
)"""]
    for i in range(rounds + 1):
        steps.append(f"""
, a{i} AS MATERIALIZED (
  SELECT r, min({{'d': CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)]) AS BIGINT), 'k': c.k}}) AS m FROM v, c{i} AS c GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""
, s{i} AS (SELECT m.k AS k, p, sum(x[p]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), unnest(range(1, 65)) AS t(p) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(n.x, c.x) AS x FROM c{i} AS c LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x FROM s{i} GROUP BY k) n USING (k)
)""")
    return "".join(steps) + f"""
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN v USING (r) JOIN c{rounds} AS c ON c.k = a.m.k
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.llm import prefix_trie

    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations"))))


OP12_SQL = """
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, own, xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten([[ascii(s), -1, -1, -1, -1, -1, -1, -1, -1] FOR s IN string_split(CAST(conv_id AS VARCHAR), '')])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 9 AS h FROM t
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5
), m AS (SELECT conv_id, len(path) AS ends, d, path[1:d] AS p FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM r)),
n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = ends), '') AS ended,
         CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].t) END AS b FROM m GROUP BY p, d
), k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
s AS (
  SELECT p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * b) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1
)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ended) AS ends_sha256
FROM f JOIN s USING (p) LEFT JOIN f q ON f.d > 0 AND q.p = f.p[1:f.d - 1]
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from photoflow.llm import byte_bpe

    return byte_bpe.digest(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_line_dedup": op2_line_dedup,
        "op3_mixing": op3_mixing,
        "op4_packing": op4_packing,
        "op5_near_vectors": op5_near_vectors,
        "op6_token_files": op6_token_files,
        "op7_license_scan": op7_license_scan,
        "op8_language_id": op8_language_id,
        "op9_exact_topk": op9_exact_topk,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_heap_clusters": op11_heap_clusters,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_byte_bpe": op13_byte_bpe,
        "pipeline": pipeline,
        "near_vectors_audit": near_vectors_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op9_exact_topk": OP9_SQL, "op10_jaccard_join": OP10_SQL, "op11_heap_clusters": _op11_sql(), "op12_prefix_trie": OP12_SQL}
