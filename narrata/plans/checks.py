"""Queries of coverage, clusterings and research, and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import qa as Q
from ..operators import terms as M
from ..sources import tables as T
from ..sources.shared import folder
from ..streaming import refresh as R
from .registry import query
from .text import ART
from .volume import VOL


@query(
    f"""{VOL}, r AS (SELECT source_id || '-' || (topic % 3) AS kind, year(day) AS year FROM vol WHERE NOT (year(day) IN (1997) AND topic % 3 = 1) AND NOT (year(day) = 1999 AND topic % 3 = 2 AND article_id % 9 <> 0)),
n AS (SELECT kind, year, count(*) AS n FROM r GROUP BY 1, 2), e AS (SELECT kind, min(year) AS a, max(year) AS b FROM n GROUP BY 1), y AS (SELECT DISTINCT year FROM n),
s AS (SELECT e.kind, y.year, coalesce(n.n, 0) AS n FROM e JOIN y ON year BETWEEN a AND b LEFT JOIN n ON n.kind = e.kind AND n.year = y.year),
l AS (SELECT *, lag(n) OVER (PARTITION BY kind ORDER BY year) AS p FROM s)
SELECT kind, CASE WHEN least(n, p) = 0 THEN 'GAP' ELSE 'CLIFF' END AS flag, CAST(year AS INTEGER) AS year, p AS before, n AS after FROM l
WHERE p IS NOT NULL AND greatest(n, p) >= 20 AND (least(n, p) = 0 OR greatest(n, p) >= 5 * least(n, p))"""
)
def coverage_flags(spark, d):
    """Cliffs and gaps between years."""
    rows = T.volume(spark, d).select(F.concat("source_id", F.lit("-"), (F.col("topic") % 3).cast("string")).alias("kind"), F.year("day").alias("year"), "topic", "article_id")
    rows = rows.where("not (year = 1997 and topic % 3 = 1) and not (year = 1999 and topic % 3 = 2 and article_id % 9 <> 0)")
    return Q.coverage_flags(rows)


@query("SELECT regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS slug, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def repeated_slugs(spark, d):
    """Path ends of more than one page."""
    return Q.repeated_slugs(T.table(spark, d, "pages"))


@query(
    rf"""{ART}, w AS (SELECT source_id AS kind, len(list_filter(regexp_split_to_array(CASE WHEN CAST(article_id AS BIGINT) % 11 = 0 THEN '' ELSE body END, '\s+'), lambda x: x <> '')) AS w FROM art),
r AS (SELECT *, w > 0 AS has, row_number() OVER (PARTITION BY kind, w > 0 ORDER BY w) - 1 AS r, count(*) OVER (PARTITION BY kind, w > 0) AS m FROM w)
SELECT kind, count(*) AS n, count(*) FILTER (NOT has) AS n_empty, count(*) FILTER (has AND w < 50) AS n_short, CAST(min(w) FILTER (has) AS INTEGER) AS w_min, CAST(max(w) FILTER (has AND r = m // 2) AS INTEGER) AS w_median,
CAST(max(w) FILTER (has AND r = floor(0.9 * (m - 1) + 0.5)) AS INTEGER) AS w_p90, CAST(max(w) FILTER (has) AS INTEGER) AS w_max FROM r GROUP BY 1"""
)
def body_fullness(spark, d):
    """Words of bodies by source."""
    body = F.when(F.col("article_id").cast("long") % 11 == 0, "").otherwise(F.col("body"))
    return Q.body_fullness(T.articles(spark, d).select(F.col("source_id").alias("kind"), body.alias("body")))


@query(
    f"""{VOL}, b AS (SELECT topic, source_id, count(DISTINCT article_id) AS n FROM vol WHERE topic <> -1 GROUP BY 1, 2), s AS (SELECT topic, max(n) / sum(n) AS share FROM b GROUP BY 1),
z AS (SELECT topic, count(DISTINCT article_id) AS size, (max(day) - min(day)) / 365.25 AS years FROM vol WHERE topic <> -1 GROUP BY 1)
SELECT count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_articles, quantile_cont(size, 0.5) AS size_median, round(quantile_cont(size, 0.9), 6) AS size_p90, count(*) FILTER (size >= 42) AS n_ge_42, count(*) FILTER (size BETWEEN 10 AND 41) AS n_10_41,
round(quantile_cont(years, 0.5), 6) AS years_median, round(quantile_cont(years, 0.9), 6) AS years_p90, avg(CAST(years > 5 AS DOUBLE)) AS share_gt5y, avg(CAST(years > 10 AS DOUBLE)) AS share_gt10y, avg(CAST(share >= 0.9 AS DOUBLE)) AS single_source_share,
(SELECT round(count(DISTINCT CASE WHEN topic = -1 THEN article_id END) / count(DISTINCT article_id), 6) FROM vol) AS noise_share FROM z JOIN s USING (topic)"""
)
def cluster_metrics(spark, d):
    """Diagnostics of a clustering."""
    out = Q.cluster_metrics(T.volume(spark, d))
    for c in ("size_p90", "years_median", "years_p90", "noise_share"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
m AS (SELECT sum(c.n / t * ln(c.n * t / (r.n * k.n))) AS mi, sum(c.n * (c.n - 1) / 2) AS s FROM c JOIN r USING (a) JOIN k USING (b) CROSS JOIN t),
x AS (SELECT -sum(n / t * ln(n / t)) AS h, sum(n * (n - 1) / 2) AS s FROM r CROSS JOIN t), y AS (SELECT -sum(n / t * ln(n / t)) AS h, sum(n * (n - 1) / 2) AS s FROM k CROSS JOIN t)
SELECT round(mi / ((x.h + y.h) / 2), 6) AS nmi, round((m.s - x.s * y.s / (t * (t - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (t * (t - 1) / 2)), 6) AS ari FROM m, x, y, t"""
)
def label_agreement(spark, d):
    """How far two labellings agree."""
    return Q.agreement(T.table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("nmi", 6).alias("nmi"), F.round("ari", 6).alias("ari"))


@query(
    """WITH n AS (SELECT o_orderpriority AS s, count(*) FILTER (o_custkey % 2 = 0) AS a, count(*) FILTER (o_custkey % 2 = 1) AS b FROM orders GROUP BY 1)
SELECT round(sum(abs(a / (SELECT sum(a) FROM n) - b / (SELECT sum(b) FROM n))) / 2, 6) AS tv FROM n"""
)
def source_variation(spark, d):
    """Distance of two sides' sources."""
    rows = T.table(spark, d, "orders").withColumn("side", F.col("o_custkey") % 2)
    return Q.total_variation(rows, "side", "o_orderpriority").select(F.round("tv", 6).alias("tv"))


DATED = """e AS (SELECT vec_id, label AS topic, CAST(DATE '2015-01-01' + CAST(vec_id * 37 % 1800 AS INTEGER) AS DATE) AS day, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""


@query(
    f"""WITH {DATED}, q AS (SELECT *, year(day) * 4 + quarter(day) AS q FROM e), g AS (SELECT topic, min(q) AS a, max(q) AS b, count(DISTINCT q) AS n_quarters FROM q GROUP BY 1 HAVING count(DISTINCT vec_id) >= 42 AND count(DISTINCT q) >= 8),
u AS (SELECT topic, q <= a + 3 AS x, q >= b - 3 AS y, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM q JOIN g USING (topic)), m AS (SELECT topic, i, avg(v) FILTER (x) AS x, avg(v) FILTER (y) AS y FROM u GROUP BY 1, 2)
SELECT m.topic, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS similarity, any_value(n_quarters) AS n_quarters FROM m JOIN g USING (topic) GROUP BY 1"""
)
def terminal_drift(spark, d):
    """How far topics moved from their first to their last year."""
    day = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("vec_id") * 37 % 1800).cast("int"))
    rows = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("label").alias("topic"), day.alias("day"), "embedding")
    return Q.terminal_drift(rows, 64).withColumn("similarity", F.round("similarity", 6))


@query(None)
def gold_scores(spark, d):
    """Labelled stories matched with clusters."""
    from .similar import _topics

    rows = _topics(spark, d)
    terms = M.labels(M.ctfidf(rows, top=10, light=False)).select("topic", "terms")
    gold = terms.select(F.concat(F.lit("story "), F.col("topic").cast("string")).alias("name"), F.slice("terms", 1, 3).alias("gold_terms"), F.lit("2012-01-01").cast("date").alias("start"), F.lit("2018-12-31").cast("date").alias("end"))
    return Q.gold_scores(gold, terms, rows)


@query(
    """WITH c AS (SELECT o_totalprice - avg(o_totalprice) OVER () AS x FROM orders), m AS (SELECT count(*) AS n, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM c),
s AS (SELECT n, m3 / power(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM m)
SELECT n, round(skewness, 4) AS skewness, round(kurtosis, 4) AS kurtosis, round((skewness * skewness + 1) / (kurtosis + 3 * (n - 1.0) * (n - 1) / ((n - 2.0) * (n - 3))), 4) AS bimodality FROM s"""
)
def bimodality(spark, d):
    """Moments and Sarle's coefficient of two modes."""
    out = C.two_modes(T.table(spark, d, "orders"), "o_totalprice")
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("skewness", "kurtosis", "bimodality")))


@query(None)
def cluster_native(spark, d):
    """Vectors clustered in Spark."""
    return C.cluster(T.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), 12).select("chunk_id", "topic")


@query(None)
def cluster_stability(spark, d):
    """Agreement of clusterings with other seeds."""
    return C.stability(T.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), 10, (42, 43))


@query(None)
def map_layout(spark, d):
    """Clusters' places on a map."""
    from .similar import _cents

    return C.layout(_cents(spark, d))


@query(None)
def encode_text(spark, d):
    """Hashed stand-in vectors of conversations."""
    rows = T.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return C.encode(rows).select("conv_id", "turn", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v), 4).alias("length"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_weekly_counts(spark, d):
    """Events counted by week as a stream that ends; the last state is read back."""
    root = folder(spark, "stream")
    rows = spark.read.parquet(f"{d}/events.parquet")
    stream = _event_stream(spark, d, rows.schema)
    counts = R.weekly_counts(stream.withColumn("time", F.col("ts").cast("timestamp")), "time", "event_type")
    R.run_now(counts.withColumn("key", F.concat_ws("|", F.col("week").cast("string"), "event_type")), f"{root}/ck", R.upsert(f"{root}/out", "key", "n"), "update").awaitTermination()
    return R.latest(spark, f"{root}/out", "key", "n").select("week", "event_type", "n")


def _event_stream(spark, d, schema):
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@query("SELECT event_id, event_type FROM events")
def stream_fresh_articles(spark, d):
    """Events without repeats within the buffer; the stream reads them twice."""
    root = folder(spark, "stream")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = _event_stream(spark, d, schema).withColumn("time", F.col("ts").cast("timestamp"))
    twice = stream.unionByName(stream)
    fresh = R.fresh_articles(twice, "time", "event_id").select("event_id", "event_type", "time")
    R.run_now(fresh, f"{root}/ck", R.upsert(f"{root}/out", "event_id", "time")).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type")
