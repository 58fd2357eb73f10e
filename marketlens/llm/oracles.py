"""DuckDB SQL for the queries that SQL can express on whole tables."""

SOURCE_MIXING = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT 0 AS round, (SELECT sum(source_size)::DOUBLE / sum(weight)::DOUBLE FROM sources) AS level
    UNION ALL
    SELECT round + 1, (
        SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE weight * l.level > 3 * source_size), 0))::DOUBLE
               / (sum(weight) FILTER (WHERE NOT weight * l.level > 3 * source_size))::DOUBLE FROM sources)
    FROM levels l WHERE round < 40
), planned AS (
    SELECT source, source_size,
           CASE WHEN weight * level > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target
    FROM sources, levels WHERE round = 40
), rated AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM planned
), ordered AS (
    SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place) AS upto
    FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END)::BIGINT AS taken
FROM ordered
"""

EXACT_TOPK = r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vector, c.vector)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES = {"op1_source_mixing": SOURCE_MIXING, "op5_exact_topk": EXACT_TOPK}
