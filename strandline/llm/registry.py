"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from strandline.llm.lines import op2_line_dedup
from strandline.llm.lmscore import op1_lm_scores
from strandline.llm.packing import op9_packing
from strandline.llm.quality import op4_quality
from strandline.llm.secrets import op5_secrets
from strandline.llm.sentencepieces import op10_sentencepiece
from strandline.llm.simhash import op8_simhash
from strandline.llm.suffixes import op3_suffix_dedup
from strandline.llm.vectors import op6_top_k, op7_embedding_dedup

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_K = f"""WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
  SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10"""

NEAR = f"""WITH RECURSIVE w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
  r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT e.vec_id, least(e.vec_id, coalesce(min(r.b), e.vec_id)) AS component_id FROM embeddings e LEFT JOIN r ON r.a = e.vec_id GROUP BY e.vec_id),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
  SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id"""


def queries() -> dict:
    named = (op1_lm_scores, op2_line_dedup, op3_suffix_dedup, op4_quality, op5_secrets, op6_top_k, op7_embedding_dedup, op8_simhash, op9_packing, op10_sentencepiece)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """Of the two on vectors. Of the others none: hashes, tokenizers, models and sums of logarithms in another order are
    outside it, or too slow over whole tables; tests hold these queries against brute force."""
    return {"op6_top_k": TOP_K, "op7_embedding_dedup": NEAR}
