"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from . import ann, langid, licenses, mixing, neardup, packing, quality, sadedup, sharding, topk

QUERIES = {
    f.__name__: f
    for f in (
        ann.op1_stable_projection_neighbours, sharding.op2_hypergeometric_shards, topk.op3_segment_bound_products, licenses.op4_license_scan, quality.op5_qda_quality,
        neardup.op6_minhash_near_duplicates, langid.op7_ecoc_language, mixing.op8_poisson_mix, sadedup.op9_two_stage_suffix_dedup, packing.op10_bounded_space_packing,
    )
}

ORACLES = {
    "op3_segment_bound_products": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.z AS DOUBLE[]), CAST(v.z AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5""",
    "op4_license_scan": licenses.op4_sql(),
    "op8_poisson_mix": mixing.op8_sql(),
}
