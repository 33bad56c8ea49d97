"""Queries of the refresh, of what is published, and of the read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts as A
from ..operators import incremental as I
from ..operators import signals as G
from ..operators import volume as V
from ..sources import tables as T
from .registry import query
from .text import ART
from .volume import ADJ, VOL

# --- refresh --------------------------------------------------------------------------------------------------------------


@query(
    f"""{VOL}, m AS (SELECT * FROM (VALUES ('one', '1-URGENT'), ('pair', '2-HIGH'), ('pair', '5-LOW'), ('none', 'absent')) t(source, member)),
l AS (SELECT source_id AS member, max(day) AS last FROM vol GROUP BY 1)
SELECT source, coalesce(min(last) - 14, DATE '2010-01-01') AS start, DATE '2001-08-15' AS "end" FROM m LEFT JOIN l USING (member) GROUP BY 1"""
)
def delta_windows(spark, d):
    """What each source must fetch."""
    members = spark.createDataFrame([("one", "1-URGENT"), ("pair", "2-HIGH"), ("pair", "5-LOW"), ("none", "absent")], "source string, member string")
    return I.delta_windows(T.volume(spark, d), members, "2001-08-15", "2010-01-01")


def _chunks(spark, d):
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha1(F.coalesce("text", F.lit(""))).alias("text_sha1"))


def _cache(spark, d):
    rows = T.table(spark, d, "documents").where("doc_id % 3 <> 0")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return rows.select(F.col("doc_id").alias("chunk_id"), F.sha1(text).alias("text_sha1"))


@query("SELECT doc_id AS chunk_id, sha1(text) AS text_sha1, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS reuse FROM documents")
def embed_plan(spark, d):
    """Which chunks keep their vectors."""
    return I.embed_plan(_chunks(spark, d), _cache(spark, d))


@query("SELECT vec_id AS chunk_id, round(list_sum(embedding), 4) AS total FROM embeddings")
def embed_assemble(spark, d):
    """Kept and fresh vectors together."""
    rows = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.sha1(F.col("vec_id").cast("string")).alias("text_sha1"), "embedding")
    out = I.assembled(rows.select("chunk_id", "text_sha1"), rows.where("chunk_id % 4 <> 0"), rows.where("chunk_id % 4 = 0"))
    return out.select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("SELECT o_orderkey AS article_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def new_articles(spark, d):
    """Articles that aren't known yet."""
    known = T.table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("article_id"))
    return I.missing(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id")), known, "article_id")


@query(
    f"""WITH {T.PRESS_SQL}, c AS (SELECT query, day, story_count FROM press WHERE day < DATE '1998-06-01'), f AS (SELECT query, day, story_count * 2 AS story_count FROM press WHERE day >= DATE '1998-05-04')
SELECT query, day, coalesce(f.story_count, c.story_count) AS story_count FROM c FULL JOIN f USING (query, day)"""
)
def merge_by_date(spark, d):
    """A cached series and its refetched tail."""
    rows = T.press(spark, d).select("query", "day", "story_count")
    fresh = rows.where("day >= date '1998-05-04'").withColumn("story_count", F.col("story_count") * 2)
    return I.merge_by_date(rows.where("day < date '1998-06-01'"), fresh, "query")


def _weeks(spark, d):
    rows = T.vectors(spark, d)
    return rows.where("chunk_id % 5 <> 0"), rows.where("chunk_id % 5 = 0").withColumn("topic", F.col("topic") + 0)


@query(
    """WITH e AS (SELECT vec_id, label AS topic, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id % 5 = 0 AS is_new, topic, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT is_new, topic, i, avg(x) AS x FROM u GROUP BY 1, 2, 3),
c AS (SELECT is_new, topic, list(x ORDER BY i) AS c, sqrt(sum(x * x)) AS n FROM m GROUP BY 1, 2),
s AS (SELECT a.topic, b.topic AS base, list_dot_product(a.c, b.c) / (a.n * b.n) AS s FROM c a JOIN c b ON a.is_new AND NOT b.is_new),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY s DESC, base) AS r FROM s), t AS (SELECT topic, base, s, s < 0.7 AS appended FROM r WHERE r = 1)
SELECT topic, CAST(CASE WHEN appended THEN 9 + row_number() OVER (PARTITION BY appended ORDER BY topic) ELSE base END AS INTEGER) AS merged, round(s, 6) AS similarity, appended FROM t"""
)
def merge_week(spark, d):
    """New topics matched with old ones."""
    return I.merge_week(*_weeks(spark, d), 64).withColumn("similarity", F.round("similarity", 6))


@query("SELECT vec_id AS chunk_id, CAST(CASE WHEN vec_id % 5 = 0 THEN 100 + label ELSE label END AS INTEGER) AS topic FROM embeddings")
def merged_assignment(spark, d):
    """Old topics kept, new chunks' added."""
    old, new = _weeks(spark, d)
    return I.merged_assignment(T.vectors(spark, d).select("chunk_id"), old, new.withColumn("topic", (F.col("topic") + 100).cast("int")))


@query("SELECT DISTINCT label AS topic FROM embeddings WHERE label >= 0 AND label NOT IN (SELECT label FROM embeddings WHERE vec_id % 5 = 0 AND label < 7)")
def identity_gate(spark, d):
    """Topics that a merge would lose."""
    old, new = _weeks(spark, d)
    return I.lost_ids(old, new.where("topic < 7"))


@query(
    """WITH o AS (SELECT c_custkey AS topic, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS topic, 'new ' || c_name AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT topic, coalesce(n.name, o.name) AS name FROM o FULL JOIN n USING (topic)"""
)
def carry_names(spark, d):
    """Names kept where there's no new one."""
    rows = T.table(spark, d, "customer").select(F.col("c_custkey").alias("topic"), F.col("c_name").alias("name"))
    return I.carry_names(rows.where("topic % 3 <> 0"), rows.where("topic % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name")))


@query("SELECT l_orderkey AS article_id, l_linenumber AS shard, l_quantity AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1")
def merge_shards(spark, d):
    """One row a key, the first shard's; where a shard has a key twice, the first in the file."""
    place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("shard"), F.col("l_quantity").alias("v"), *place)
    return I.merge_shards(rows, "article_id", "shard", "__file", "__row").drop("__file", "__row")


@query("SELECT o_orderkey % 4 AS shard, count(*) AS n, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)) AS open FROM orders GROUP BY 1")
def shard_progress(spark, d):
    """Ids by modulo shard, and those not yet done."""
    done = T.table(spark, d, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("done", F.lit(1))
    rows = T.table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left")
    return rows.groupBy(F.pmod("o_orderkey", F.lit(4)).alias("shard")).agg(F.count("*").alias("n"), F.count_if(F.col("done").isNull()).alias("open"))


# --- published ------------------------------------------------------------------------------------------------------------


def _index(spark, d):
    rows = T.volume(spark, d).where("topic <> -1")
    parts = rows.groupBy("topic").agg(F.countDistinct("article_id").alias("n_articles"), F.min("day").alias("first"), F.max("day").alias("last"))
    stages = parts.where("topic % 3 <> 0").select("topic", F.element_at(F.array(*(F.lit(x) for x in ("growth", "stable", "decay", "dormant"))), F.col("topic") % 4 + 1).alias("stage"))
    codes = parts.where("topic % 2 = 0").select("topic", (F.col("topic") % 4 == 0).alias("in_scope"))
    names = parts.select("topic", F.when(F.col("topic") % 5 == 0, F.concat(F.lit("Story "), F.col("topic").cast("string"))).alias("human"), F.concat(F.col("topic").cast("string"), F.lit("_rate_price_"), F.col("topic").cast("string")).alias("label"))
    return A.index(parts, stages, codes, names)


INDEX = f"""{VOL}, p AS (SELECT topic, count(DISTINCT article_id) AS n_articles, min(day) AS first, max(day) AS last FROM vol WHERE topic <> -1 GROUP BY 1),
i0 AS (SELECT *, CASE WHEN topic % 3 <> 0 THEN ['growth', 'stable', 'decay', 'dormant'][topic % 4 + 1] ELSE 'dormant' END AS stage, CASE WHEN topic % 2 = 0 THEN topic % 4 = 0 ELSE true END AS in_scope,
  CASE WHEN topic % 5 = 0 THEN 'Story ' || topic END AS human, topic || '_rate_price_' || topic AS label FROM p),
idx AS (SELECT *, row_number() OVER (ORDER BY in_scope DESC, n_articles DESC, topic) AS place FROM i0)"""


@query(f"{INDEX} SELECT topic, n_articles, first, last, stage, in_scope, human, label, CAST(place AS INTEGER) AS place FROM idx")
def index(spark, d):
    """The catalogue with its defaults, in its order."""
    return _index(spark, d)


@query(f"""{INDEX} SELECT topic, '{{"topic":' || topic || ',"n_articles":' || n_articles || ',"stage":"' || stage || '","share":' || CASE WHEN topic % 7 = 0 THEN 'null' ELSE '0.5' END || '}}' AS json FROM idx""")
def narrative_documents(spark, d):
    """A JSON document a cluster; what isn't finite is null."""
    share = F.when(F.col("topic") % 7 == 0, F.lit(float("nan"))).otherwise(0.5)
    return A.documents(_index(spark, d).select("topic", "n_articles", "stage", share.alias("share")))


@query(f"""{INDEX} SELECT '[' || string_agg('{{"topic":' || topic || ',"n":' || n_articles || '}}', ',' ORDER BY topic) || ']' AS json FROM idx""")
def directory(spark, d):
    """One document of all clusters."""
    return A.directory(_index(spark, d).select("topic", F.col("n_articles").alias("n")))


@query(f"{VOL}, {ADJ} SELECT topic, CAST(date_trunc('week', day - 1) AS DATE) AS week, round(avg(adjusted), 4) AS mean FROM adj WHERE topic <> -1 GROUP BY 1, 2")
def light_series(spark, d):
    """Weekly means of topics under a floor (here above all) by weeks after Monday."""
    topics = T.volume(spark, d).where("topic <> -1").groupBy("topic").agg(F.countDistinct("article_id").alias("n")).where("n < 1000000000")
    return A.light(V.adjusted_volume(T.volume(spark, d)), topics)


@query(f"{INDEX} SELECT topic, coalesce(human, replace(regexp_replace(label, '^-?[0-9]+_', ''), '_', ', ')) AS name FROM idx")
def display_names(spark, d):
    """Names as shown."""
    return _index(spark, d).select("topic", A.display_name(F.col("human"), F.col("label")).alias("name"))


@query(f"{INDEX} SELECT topic FROM idx WHERE contains(lower(label), 'price_1') AND stage IN ('growth', 'dormant') AND in_scope")
def catalogue_filter(spark, d):
    """The catalogue by text, stages and scope."""
    rows = _index(spark, d).withColumn("terms", F.array(F.lit("rates")))
    return A.catalogue(rows, " Price_1 ", ("growth", "dormant"), True).select("topic")


@query(f"{INDEX} SELECT topic FROM idx WHERE topic % 3 = 0 OR stage IN ('growth')")
def emerging_filter(spark, d):
    """The emerging list: rows without a stage pass its facet."""
    rows = _index(spark, d).withColumn("stage", F.when(F.col("topic") % 3 != 0, F.col("stage"))).withColumn("terms", F.array(F.lit("rates")))
    return A.catalogue(rows, "", ("growth",), stageless_pass=True).select("topic")


@query(f"{INDEX} SELECT topic FROM idx WHERE (contains(lower(coalesce(human, '')), 'story 1') OR contains(label, 'story 1')) AND topic % 10 = 0")
def directory_filter(spark, d):
    """The directory by text and tier."""
    rows = _index(spark, d).withColumn("name", F.coalesce("human", F.lit(""))).withColumn("surfaced", F.col("topic") % 10 == 0)
    return A.directory_filter(rows, "Story 1", True).select("topic")


@query(f"{INDEX} SELECT topic, CAST(place AS INTEGER) AS place FROM idx ORDER BY place OFFSET 20 LIMIT 20")
def page(spark, d):
    """The last page, asked for beyond the end."""
    return A.page(_index(spark, d).select("topic", "place"), [F.col("place")], 99, 20)


@query(f"{INDEX} SELECT CAST(sum(n_articles) AS BIGINT) AS articles, max(last) AS frontier, count(*) AS clusters FROM idx")
def site_totals(spark, d):
    """The front page's numbers."""
    return _index(spark, d).agg(F.sum("n_articles").alias("articles"), F.max("last").alias("frontier"), F.count("*").alias("clusters"))


@query("SELECT CASE WHEN n_regionkey IN (1, 2) THEN 'regional' ELSE CAST(n_regionkey AS VARCHAR) END AS source, CAST(sum(n_nationkey) AS BIGINT) AS n FROM nation GROUP BY 1")
def regional_roll_up(spark, d):
    """Sources of a group as one."""
    rows = T.table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("source_id"), F.col("n_nationkey").cast("long").alias("n"))
    return A.roll_up(rows, {"1": "regional", "2": "regional"})


@query(
    f"""{VOL}, y AS (SELECT topic, CAST(n AS DOUBLE) AS v, row_number() OVER (PARTITION BY topic ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY topic) AS k FROM (SELECT topic, date_trunc('month', day) AS m, count(*) AS n FROM vol GROUP BY 1, 2)),
b AS (SELECT DISTINCT topic, k, unnest(generate_series(0, least(k, 44) - 1)) AS b FROM y), c AS (SELECT topic, b, floor(b * (k / least(k, 44))) AS a, greatest(floor((b + 1) * (k / least(k, 44))), floor(b * (k / least(k, 44))) + 1) AS z FROM b)
SELECT c.topic, CAST(b AS INTEGER) AS pos, round(avg(v), 6) AS mean FROM c JOIN y ON y.topic = c.topic AND i >= a AND i < z GROUP BY 1, 2"""
)
def sparklines(spark, d):
    """Monthly counts in 44 buckets."""
    rows = T.volume(spark, d).groupBy("topic", F.trunc("day", "MM").alias("m")).agg(F.count("*").cast("double").alias("n"))
    packed = rows.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "n"))), lambda s: s["n"]).alias("v"))
    return packed.select("topic", F.posexplode(A.sparkline(F.col("v"))).alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query(f"{INDEX}, m AS (SELECT min(n_articles) AS a, max(n_articles) AS b FROM idx) SELECT topic, round(greatest(3, 6 + 12 * pow((ln(1 + n_articles) - ln(1 + a)) / (ln(1 + b) - ln(1 + a)), 0.67)), 6) AS size FROM idx CROSS JOIN m")
def node_sizes(spark, d):
    """Sizes on the map."""
    rows = _index(spark, d)
    ends = rows.agg(F.min("n_articles").alias("a"), F.max("n_articles").alias("b"))
    return rows.crossJoin(F.broadcast(ends)).select("topic", F.round(A.node_size(F.col("n_articles"), F.col("a"), F.col("b")), 6).alias("size"))


@query("SELECT topic, pos, round((v - a) / (b - a) * 90, 6) AS height FROM (SELECT vec_id AS topic, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(list_min(embedding) AS DOUBLE) AS a, CAST(list_max(embedding) AS DOUBLE) AS b FROM embeddings)")
def bar_heights(spark, d):
    """Values between their ends."""
    rows = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("topic"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.select("topic", F.posexplode(A.bar_heights(F.col("v"), 90.0)).alias("pos", "height")).withColumn("height", F.round("height", 6))


@query(
    f"""{VOL}, e AS (SELECT o_custkey AS topic, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS onset FROM orders GROUP BY 1)
SELECT CAST(topic AS INTEGER) AS topic, n FROM e WHERE n < 42 AND n >= 3 AND onset >= (SELECT max(day) FROM vol) - 1120 ORDER BY n DESC, topic"""
)
def forming_list(spark, d):
    """Forming topics, most articles first."""
    from .signals import _customers

    return G.forming(_customers(spark, d), weeks=160).where("forming").select("topic", F.col("n_articles").alias("n")).orderBy(F.desc("n"), "topic")


@query(f"{ART} SELECT article_id, sha1('[' || source_id || ']' || language) AS signature FROM art")
def name_signature(spark, d):
    """Keys of kept names, over parts that matter."""
    return T.articles(spark, d).select("article_id", F.sha1(F.concat(F.lit("["), "source_id", F.lit("]"), "language")).alias("signature"))


@query(None)
def card_signature(spark, d):
    """Keys under which clusters' names are kept."""
    from ..operators import cards as K
    from .similar import _topics

    rows = _topics(spark, d).groupBy("topic").agg(F.array_sort(F.collect_set("source_id")).alias("s"), F.min_by("body", "article_id").alias("b"))
    return rows.select("topic", K.signature(F.col("s"), F.array("b"), F.col("s"), "none", "1").alias("signature"))
