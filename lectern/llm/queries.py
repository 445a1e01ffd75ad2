"""The registered queries of this package, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from . import contamination, jaccard_join, language, line_dedup, neighbours, packing, preference, sharding, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_sharding": sharding.op2_sharding,
    "op3_decontamination": contamination.op3_decontamination,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_warc_derivatives": warc.op5_warc_derivatives,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": language.op7_language_id,
    "op8_preference_formatting": preference.op8_preference_formatting,
    "op9_nearest_neighbours": neighbours.op9_nearest_neighbours,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL = {
    "op2_sharding": sharding.OP2_SQL,
    "op3_decontamination": contamination.OP3_SQL,
    "op4_ngram_jaccard_join": jaccard_join.OP4_SQL,
    "op9_nearest_neighbours": neighbours.OP9_SQL,
}
