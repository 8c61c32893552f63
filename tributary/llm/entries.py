"""The queries of this package: op1 to op10 by name, and SQL where SQL can express them."""

from tributary.llm import bpe, jaccard, media, mixing, quality, substring_dedup, suffix_dedup, token_output, topk, toxicity

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_token_output": token_output.op4_token_output,
    "op5_media_columns": media.op5_media_columns,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_mixing": mixing.op9_mixing,
    "op10_topk": topk.op10_topk,
}
ORACLES = {
    "op9_mixing": mixing.OP9_SQL,
    "op10_topk": topk.OP10_SQL,
}
