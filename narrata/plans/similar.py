"""Queries over clusters: vectors, neighbours, terms, cards, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import cards as K
from ..operators import dedup as D
from ..operators import similar as S
from ..operators import terms as M
from ..sources import tables as T
from .registry import query
from .text import ART
from .volume import SMOOTH, VOL, _smooth

WIDTH = 64
CENT = """WITH e AS (SELECT label AS topic, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
ca AS (SELECT topic, i, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
cent AS (SELECT topic, list(m ORDER BY i) AS c, sqrt(sum(m * m)) AS n FROM ca GROUP BY 1)"""


def _cents(spark, d):
    return S.centroids(T.vectors(spark, d), WIDTH)


@query(f"{CENT} SELECT topic, CAST(i - 1 AS INTEGER) AS pos, round(m, 6) AS mean FROM ca")
def centroids(spark, d):
    """Mean vectors of clusters, by place."""
    return _cents(spark, d).select("topic", F.posexplode("centroid").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


PAIRS = f"""{CENT}, p AS (SELECT a.topic AS src, b.topic AS dst, list_dot_product(a.c, b.c) / (a.n * b.n) AS score FROM cent a JOIN cent b ON a.topic <> b.topic),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p)"""


@query(f"{PAIRS} SELECT src, dst, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def semantic_topk(spark, d):
    """Five nearest clusters by meaning."""
    return S.semantic(_cents(spark, d)).withColumn("score", F.round("score", 6))


@query(f"{PAIRS} SELECT src, dst, round(score, 6) AS weight FROM r WHERE rank <= 10")
def semantic_weighted(spark, d):
    """Ten nearest clusters by meaning, with the weights of their edges."""
    return S.semantic(_cents(spark, d), 10).select("src", "dst", F.round("score", 6).alias("weight"))


@query(f"{PAIRS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(score), 6) AS weight FROM r WHERE rank <= 3 GROUP BY 1, 2")
def semantic_edges(spark, d):
    """The map's edges: three nearest each, each pair once."""
    best = S.semantic(_cents(spark, d), 3)
    return best.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.round(F.max("score"), 6).alias("weight"))


def _prototypes(spark, d):
    """Means of vectors dealt to the codes stand for the codes' encoded descriptions."""
    rows = T.table(spark, d, "embeddings").withColumn("code", F.substring(F.lit(S.CODES), (F.col("vec_id") % len(S.CODES)).cast("int") + 1, F.lit(1)))
    return S.centroids(rows, WIDTH, "code").select("code", F.col("centroid").alias("vector"))


@query(
    f"""{CENT}, pu AS (SELECT substr('{S.CODES}', CAST(vec_id % {len(S.CODES)} AS INTEGER) + 1, 1) AS code, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
pm AS (SELECT code, i, avg(CAST(x AS DOUBLE)) AS x FROM pu GROUP BY 1, 2), pr AS (SELECT code, list(x ORDER BY i) AS v FROM pm GROUP BY 1),
s AS (SELECT topic, code, list_dot_product(c, v) / (n * sqrt(list_dot_product(v, v))) AS s FROM cent CROSS JOIN pr),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY s DESC, code) AS r FROM s)
SELECT a.topic, a.code AS primary_code, round(a.s, 6) AS similarity, b.code AS runner_up, round(a.s - b.s, 6) AS runner_up_gap, a.code IN ('E', 'F', 'G', 'H', 'J') AS in_scope
FROM r a JOIN r b ON a.topic = b.topic AND a.r = 1 AND b.r = 2"""
)
def code_assign(spark, d):
    """Clusters' taxonomy codes."""
    out = S.assign_codes(_cents(spark, d), _prototypes(spark, d))
    return out.withColumn("similarity", F.round("similarity", 6)).withColumn("runner_up_gap", F.round("runner_up_gap", 6))




@query(
    """WITH t AS (SELECT DISTINCT p_size % 20 AS topic, lower(w) AS term FROM (SELECT p_size, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''),
n AS (SELECT topic, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT a.topic AS src, b.topic AS dst, count(*) AS c FROM t a JOIN t b ON a.term = b.term AND a.topic <> b.topic GROUP BY 1, 2),
s AS (SELECT src, dst, c / (x.n + y.n - c) AS score FROM p JOIN n x ON x.topic = src JOIN n y ON y.topic = dst),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s)
SELECT src, dst, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def lexical_topk(spark, d):
    """Five nearest by shared terms (part names by size class)."""
    rows = T.table(spark, d, "part").select((F.col("p_size") % 20).alias("topic"), F.explode(F.split("p_name", " ")).alias("w")).where("w <> ''")
    terms = rows.groupBy("topic").agg(F.collect_set(F.lower("w")).alias("terms"))
    return S.lexical(terms).withColumn("score", F.round("score", 6))


@query(
    f"""{VOL}, {SMOOTH}, f AS (SELECT topic, min(i) FILTER (y <> 0) AS f FROM smooth WHERE topic <> -1 GROUP BY 1),
z AS (SELECT topic, i - f AS k, y FROM smooth JOIN f USING (topic) WHERE i >= f), mx AS (SELECT max(k) AS m FROM z),
g AS (SELECT topic, unnest(generate_series(0, (SELECT m FROM mx))) AS k FROM f),
q AS (SELECT topic, k, coalesce(y, 0) AS y FROM g LEFT JOIN z USING (topic, k)),
p AS (SELECT a.topic AS src, b.topic AS dst, round(corr(a.y, b.y), 9) AS score FROM q a JOIN q b ON a.k = b.k AND a.topic <> b.topic GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p)
SELECT src, dst, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def morphological_topk(spark, d):
    """Five nearest by the shape of their curves."""
    return S.morphological(_smooth(spark, d)).withColumn("score", F.round("score", 6))


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE label IN (0, 1)),
m AS (SELECT i, avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0) AS d FROM u GROUP BY 1),
ax AS (SELECT list(d ORDER BY i) AS a FROM m), n AS (SELECT list_transform(a, lambda q: q / sqrt(list_dot_product(a, a))) AS a FROM ax),
s AS (SELECT vec_id, label, list_dot_product(v, a) AS s FROM e CROSS JOIN n)
SELECT vec_id, round(s - (SELECT avg(s) FROM s), 6) AS stance FROM s"""
)
def stance_axis(spark, d):
    """Vectors' place between two labels' means."""
    rows = T.table(spark, d, "embeddings")
    return S.stance(rows, F.col("label") == 0, F.col("label") == 1, WIDTH).select("vec_id", F.round("stance", 6).alias("stance"))


TOPICS = "CAST(CAST(article_id AS BIGINT) % 12 AS INTEGER)"


def _topics(spark, d):
    return T.articles(spark, d).withColumn("topic", (F.col("article_id").cast("long") % 12).cast("int"))


STOPS = ", ".join(f"'{w}'" for w in M.STOP)
TOKENS = rf"""{ART}, tw AS (SELECT {TOPICS} AS topic, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({STOPS})) AS w FROM art),
tk AS (SELECT topic, unnest(w) AS term FROM tw UNION ALL SELECT topic, w[i] || ' ' || w[i + 1] FROM (SELECT topic, w, unnest(generate_series(1, len(w) - 1)) AS i FROM tw)),
tf AS (SELECT topic, term, count(*) AS tf FROM tk GROUP BY 1, 2)"""


@query(
    f"""{TOKENS}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
g AS (SELECT topic, term, tf * ln(1 + (SELECT count(DISTINCT topic) FROM tf) / (1 + df)) AS weight FROM tf JOIN df USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY floor(weight * 1e9 + 0.5) DESC, term) AS rank FROM g)
SELECT topic, term, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8"""
)
def ctfidf_light(spark, d):
    """Eight terms of each cluster."""
    return M.ctfidf(_topics(spark, d)).withColumn("weight", F.round("weight", 6))


CT = f"""{TOKENS}, sz AS (SELECT topic, sum(tf) AS size FROM tf GROUP BY 1), al AS (SELECT term, sum(tf) AS n FROM tf GROUP BY 1),
g AS (SELECT topic, term, tf / size * ln(1 + (SELECT avg(size) FROM sz) / n) AS weight FROM tf JOIN sz USING (topic) JOIN al USING (term)),
ct AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY floor(weight * 1e9 + 0.5) DESC, term) AS rank FROM g)"""


@query(f"{CT} SELECT topic, term, round(weight, 8) AS weight, CAST(rank AS INTEGER) AS rank FROM ct WHERE rank <= 10")
def ctfidf_terms(spark, d):
    """Ten terms of each cluster by share."""
    return M.ctfidf(_topics(spark, d), top=10, light=False).withColumn("weight", F.round("weight", 8))


@query(f"{CT} SELECT topic, CAST(topic AS VARCHAR) || '_' || string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS name FROM ct WHERE rank <= 10 GROUP BY 1")
def cluster_labels(spark, d):
    """Clusters' raw names."""
    return M.labels(M.ctfidf(_topics(spark, d), top=10, light=False)).select("topic", "name")


@query(
    f"""{VOL}, b AS (SELECT topic, source_id, count(DISTINCT article_id) AS n FROM vol GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, source_id) AS rank FROM b)
SELECT topic, source_id, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8"""
)
def source_mix(spark, d):
    """Topics' sources."""
    return K.source_mix(T.volume(spark, d))


@query(
    f"""{VOL}, y AS (SELECT topic, day, count(DISTINCT article_id) AS n FROM vol GROUP BY 1, 2)
SELECT topic, min(day) AS first, max(day) AS last, arg_max(day, struct_pack(n := n, d := DATE '1990-01-01' - day)) AS peak_day, CAST(sum(n) AS BIGINT) AS article_days FROM y GROUP BY 1"""
)
def peak_day(spark, d):
    """Topics' span and loudest day."""
    return K.date_facts(T.volume(spark, d))


@query(
    f"""{CT}, tt AS (SELECT topic, list(term ORDER BY rank) AS terms FROM ct WHERE rank <= 5 GROUP BY 1),
a AS (SELECT article_id, {TOPICS} AS topic, day, body FROM art),
s AS (SELECT a.*, CAST(list_sum(list_transform(terms, lambda t: (length(lower(body)) - length(replace(lower(body), lower(t), ''))) // length(t))) AS INTEGER) AS hits FROM a JOIN tt USING (topic)),
c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY hits DESC, length(body) DESC, day DESC, article_id) AS c FROM s),
e AS (SELECT *, CASE WHEN c > 3 THEN row_number() OVER (PARTITION BY topic, c > 3 ORDER BY day, article_id) END AS e FROM c),
l AS (SELECT *, CASE WHEN e > 3 THEN row_number() OVER (PARTITION BY topic, coalesce(e > 3, false) ORDER BY day DESC, article_id) END AS l FROM e)
SELECT topic, CASE WHEN c <= 3 THEN 'central' WHEN e <= 3 THEN 'earliest' ELSE 'newest' END AS panel, CAST(CASE WHEN c <= 3 THEN c WHEN e <= 3 THEN e ELSE l END AS INTEGER) AS rank, article_id, hits
FROM l WHERE c <= 3 OR e <= 3 OR l <= 3"""
)
def story_card(spark, d):
    """Central, earliest and newest articles of each cluster."""
    rows = _topics(spark, d)
    terms = M.labels(M.ctfidf(rows, top=5, light=False)).select("topic", "terms")
    return K.panels(rows, terms).select("topic", "panel", "rank", "article_id", "hits")


@query(f"{ART} SELECT CAST(round_even(median(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> ''))), 0) AS BIGINT) AS median_words FROM art")
def median_words(spark, d):
    """Words of the median article."""
    return K.median_words(T.articles(spark, d))


@query("SELECT sha1(text) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    """Texts that occur twice or more."""
    return D.exact(T.table(spark, d, "documents"), "doc_id", "text")


@query(
    r"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+'), lambda x: length(x) >= 8))) AS w FROM documents),
k AS (SELECT min(doc_id) AS id, w, count(*) AS n_docs FROM w WHERE len(w) > 0 GROUP BY w), s AS (SELECT id, unnest(w) AS w FROM k),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, round(c / (len(x.w) + len(y.w) - c), 6) AS similarity, x.n_docs AS docs_a, y.n_docs AS docs_b FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE c / (len(x.w) + len(y.w) - c) >= 0.85"""
)
def jaccard_pairs(spark, d):
    """Documents with nearly the same long words, exactly; documents with the same words are one class."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 8)
    return D.exact_pairs(T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_sort(F.array_distinct(words)).alias("w")), 0.85)


@query(None)
def minhash_keep_first(spark, d):
    """Near duplicates, the earliest kept."""
    return D.keep_first(T.articles(spark, d))


@query(None)
def minhash_keep_first_in_window(spark, d):
    """Near duplicates of at most thirty days before, the earliest kept; a later copy starts anew."""
    return D.keep_first(T.articles(spark, d), window_days=30)


@query(
    """WITH e AS (SELECT vec_id % 100 AS article_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT article_id, CAST(pos AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM e GROUP BY 1, 2"""
)
def mean_pool(spark, d):
    """Articles' vectors as their chunks' means."""
    rows = T.table(spark, d, "embeddings").withColumn("article_id", F.col("vec_id") % 100)
    return S.centroids(rows, WIDTH, "article_id").select("article_id", F.posexplode("centroid").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS length, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS unit_sum FROM e"""
)
def unit_vectors(spark, d):
    """Vectors' length, and the sum of their unit form."""
    return T.table(spark, d, "embeddings").select("vec_id", F.round(X.norm("embedding"), 6).alias("length"), F.round(F.aggregate(X.unit("embedding"), F.lit(0.0), lambda s, v: s + v), 6).alias("unit_sum"))
