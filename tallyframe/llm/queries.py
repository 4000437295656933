"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import graphsearch, licenses, maxent, minhash, mixing, neighbours, pieces, quality, resample, shards, tokencount, urls, zonemaps

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffled
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM sized GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][CAST(number % 3 AS INT) + 1] AS weight FROM sources),
running AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_words,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
           - 2 * coalesce(CAST(sum(source_size) OVER earlier AS BIGINT), 0) AS left_words,
         CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER earlier AS BIGINT), 0) AS left_weight
  FROM weighted
  WINDOW earlier AS (ORDER BY source_size::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, weight * left_words / left_weight >= 2 * source_size AS stopped FROM running),
rate AS (SELECT left_words, left_weight FROM stopped WHERE NOT stopped
         ORDER BY source_size::DOUBLE / weight, number LIMIT 1),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.stopped THEN CAST(2 * s.source_size AS DOUBLE)
              ELSE s.weight * r.left_words / r.left_weight END AS target
  FROM stopped s LEFT JOIN rate r ON true),
laid AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffled, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized),
taken AS (
  SELECT doc_id, size, source_size, target, [0.0, 0.5, -0.5][CAST(number % 3 AS INT) + 1]::DOUBLE AS slope,
         epoch, start + epoch * source_size AS place_at,
         greatest(least(size, CAST(round(target) AS BIGINT) - start - epoch * source_size), 0) AS words
  FROM laid JOIN (SELECT t.*, s.number FROM targets t JOIN sources s ON t.source IS NOT DISTINCT FROM s.source) t
    ON laid.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) e(epoch)),
timed AS (
  SELECT *, CASE WHEN words > 0 THEN CASE WHEN place_at / target <= 0 THEN 0 ELSE 2 * least(place_at / target, 1)
         / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * least(place_at / target, 1))) END END AS due
  FROM taken),
placed AS (
  SELECT *, CASE WHEN words > 0 THEN row_number() OVER (PARTITION BY words > 0 ORDER BY due, doc_id, epoch) - 1 END AS position
  FROM timed)
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken,
       round(max(due) FILTER (epoch = 0), 9) AS first_due, round(max(due) FILTER (epoch = 1), 9) AS second_due,
       max(position) FILTER (epoch = 0) AS first_position, max(position) FILTER (epoch = 1) AS second_position
FROM placed GROUP BY doc_id, size, source_size, target
"""


@query("op1_mix", MIX_SQL)
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.training_positions(mixing.mix(documents(spark, sf_dir)))
    times = [F.round(F.col("parts")[i]["due"], 9).alias(f"{name}_due") for i, name in enumerate(("first", "second"))]
    places = [F.col("positions")[i].alias(f"{name}_position") for i, name in enumerate(("first", "second"))]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *times, *places)


@query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_licenses(documents(spark, sf_dir))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_shards")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.stratified_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS shingle
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w), 2))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach AS (
  SELECT a AS id, a AS other FROM links
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least_id AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
       coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_id c ON c.id = d.doc_id
"""


@query("op3_near_duplicates", NEAR_SQL)
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), minhash.Settings(shingle=2))


VECTOR_SQL = """
WITH RECURSIVE vectors AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
degrees AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a),
reach AS (
  SELECT a AS id, a AS other FROM links
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least_id AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component, e.vec_id) AS component_id,
       coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degrees d ON d.id = e.vec_id LEFT JOIN least_id c ON c.id = e.vec_id
"""


@query("op10_near_vectors", VECTOR_SQL)
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op2_lm_scores")
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(documents(spark, sf_dir))


@query("op4_sampled_pieces")
def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


RESAMPLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda c, _: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, true AS corpus, text FROM documents
  UNION ALL SELECT NULL, NULL, false, text FROM benchmark),
words AS (
  SELECT *, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM texts),
features AS (
  SELECT row, corpus, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
  FROM words),
hashed AS (
  SELECT feature, xor(list_reduce(range(len(h)), lambda c, i: xor(c >> 4,
      t[(xor(c, instr('0123456789abcdef', h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1) & 15) + 1]),
      4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT feature, lower(hex(feature)) AS h FROM (SELECT DISTINCT feature FROM features)), crc_table),
totals AS (
  SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t
  FROM features JOIN hashed USING (feature) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE + 10000 AS all_s, sum(t)::DOUBLE + 10000 AS all_t FROM totals),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * all_s / ((s + 1)::DOUBLE * all_t)))::BIGINT AS gain FROM totals, sums),
weights AS (
  SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE corpus GROUP BY row),
scored AS (
  SELECT doc_id, len(w) >= 20 AS drawable, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row) WHERE corpus),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY drawable ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) OVER (PARTITION BY drawable) AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN drawable AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""


@query("op11_resample", RESAMPLE_SQL)
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _cluster_sql(rounds: int = 10, clusters: int = 8, width: int = 64) -> str:
    """Centroid clustering in SQL: one pair of tables per round; distance and centroid number share a long."""
    nearest = f"""SELECT vec_id, v.x, min({clusters} * list_sum(list_transform(list_zip(v.x, c.x),
      lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT + c.cluster) AS far
  FROM kept v, c{{0}} c GROUP BY ALL"""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, x FROM kept
  ORDER BY sha256('3:' || vec_id) LIMIT {clusters})""",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY axis) AS x FROM (
      SELECT far % {clusters} AS cluster, axis, sum(x[axis])::BIGINT AS s, count(*) AS n
      FROM a{i}, range(1, {width + 1}) r(axis) GROUP BY ALL) GROUP BY cluster) n ON n.cluster = c.cluster)""")
    parts.append(f"done AS MATERIALIZED ({nearest.format(rounds)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(d.cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY d.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM (SELECT vec_id, far % {clusters} AS cluster, far // {clusters} AS distance FROM done) d
JOIN c{rounds} c ON c.cluster = d.cluster
"""


@query("op13_centroids", _cluster_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemaps.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SEARCH_SQL = """
WITH vectors AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 20
"""


@query("op12_nearest", SEARCH_SQL)
def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = graphsearch.search(vectors, vectors.where("vec_id % 20 = 0"))
    return found.select("query_id", "rank", "vec_id", "score")
