"""The queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from .bpe import op2_byte_bpe
from .chunks import op8_gear_chunks
from .graph import op1_pruned_graph
from .gridjoin import op4_grid_order_join
from .minhash import op6_bayes_minhash
from .packing import op3_histogram_packing
from .quality import op7_co_training
from .secrets import op5_guess_cost_secrets
from .sharding import op9_rendezvous_shards
from .toxicity import op10_factorization_machine

QUERIES = {
    f.__name__: f
    for f in (
        op1_pruned_graph, op2_byte_bpe, op3_histogram_packing, op4_grid_order_join, op5_guess_cost_secrets, op6_bayes_minhash, op7_co_training, op8_gear_chunks, op9_rendezvous_shards, op10_factorization_machine,
    )
}
_REACH = """r(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, e.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) e ON e.a = r.b),
c AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY 1)"""

_DOT = "list_reduce(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]), lambda s, x: s + x)"
_COSINE = f"{_DOT.format('q.v', 'x.v')} / (sqrt({_DOT.format('q.v', 'q.v')}) * sqrt({_DOT.format('x.v', 'x.v')}))"

ORACLE_SQL: dict[str, str] = {
    # The exact neighbours, which the graphs find to the last one on small tables.
    "op1_pruned_graph": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, {_COSINE} AS score FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""",
    "op4_grid_order_join": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ids AS (SELECT vec_id AS id FROM embeddings),
e AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.9),
n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1), {_REACH}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n USING (id)""",
    "op6_bayes_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
ids AS (SELECT doc_id AS id FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), {_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM c LEFT JOIN n ON doc_id = id""",
}
