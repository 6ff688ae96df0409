"""Names under which the driver runs the queries of this package."""

from nimbora.llm import queries as q

QUERIES = {
    "op1_multi_index_search": q.nearest_vectors,
    "op2_license_scan": q.license_scan,
    "op3_curve_packing": q.packing,
    "op4_chosen_path_dedup": q.near_dedup,
    "op5_norm_bucket_search": q.largest_products,
    "op6_nbest_pieces": q.piece_segmentations,
    "op7_personal_data": q.personal_spans,
    "op8_toxicity": q.toxicity_scores,
    "op9_language": q.languages,
    "op10_token_files": q.token_files,
    "op11_periodic_runs": q.periodic_runs,
    "op12_spelling_variants": q.spelling_variants,
    "op13_credentials": q.linked_credentials,
}
ORACLE: dict[str, str] = {}
