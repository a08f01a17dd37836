"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from podium.llm.bpe import op4_bpe_round_trip
from podium.llm.embed_dedup import op5_embedding_near_dedup
from podium.llm.html import op6_html_extraction
from podium.llm.lines import op8_line_dedup
from podium.llm.packing import op2_best_fit_packing
from podium.llm.sharding import op9_histogram_shards
from podium.llm.simhash import op7_simhash_near_dedup
from podium.llm.topk import op3_pivot_top_k
from podium.llm.toxicity import op10_pu_toxicity
from podium.llm.urls import op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pivot_top_k": op3_pivot_top_k,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_histogram_shards": op9_histogram_shards,
    "op10_pu_toxicity": op10_pu_toxicity,
}

ORACLE_SQL: dict[str, str] = {}
