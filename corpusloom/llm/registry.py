"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import language_id, licenses, merkle, mixing, near_duplicates, phrases, prefix_forest, quality_rules, sentencepieces, surrogates, token_counts, token_store, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pii_surrogates": surrogates.op2_pii_surrogates,
    "op3_language_id": language_id.op3_language_id,
    "op4_sentencepiece": sentencepieces.op4_sentencepiece,
    "op5_quality_cascade": quality_rules.op5_quality_cascade,
    "op6_simhash_near_duplicates": near_duplicates.op6_simhash_near_duplicates,
    "op7_prefix_forest": prefix_forest.op7_prefix_forest,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_pareto_mixing": mixing.op9_pareto_mixing,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_token_store": token_store.op11_token_store,
    "op12_setm_phrases": phrases.op12_setm_phrases,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op5_quality_cascade": quality_rules.SQL,
    "op9_pareto_mixing": mixing.SQL,
    "op11_token_store": token_store.op11_token_store,
    "op12_setm_phrases": phrases.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
