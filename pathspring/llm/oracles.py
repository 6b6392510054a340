"""DuckDB SQL for the operators' queries."""

TOPK = """
WITH v AS (
  SELECT vec_id, [floor(256 * y::DOUBLE)::BIGINT FOR y IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum([q.x[i] * c.x[i] FOR i IN range(1, len(q.x) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5"""
