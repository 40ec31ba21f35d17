"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tickloom.llm.bpe import op5_bpe
from tickloom.llm.chat import OP4_SQL, op4_chat_formatting
from tickloom.llm.classifier import op7_quality_classifier
from tickloom.llm.divergence import OP12_SQL, op12_source_divergence
from tickloom.llm.fingerprints import OP6_SQL, op6_document_fingerprints
from tickloom.llm.lexical import OP11_SQL, op11_ranked_search
from tickloom.llm.metric_join import op9_embedding_near_dedup
from tickloom.llm.minhash import op2_minhash_near_dedup
from tickloom.llm.mixing import op10_mix_sources
from tickloom.llm.neighbours import op13_nearest_neighbours
from tickloom.llm.suffix_dedup import op1_suffix_array_dedup
from tickloom.llm.token_files import op3_token_files
from tickloom.llm.url_filter import OP8_SQL, op8_url_filters

_QUERIES = (op1_suffix_array_dedup, op2_minhash_near_dedup, op3_token_files, op4_chat_formatting, op5_bpe, op6_document_fingerprints, op7_quality_classifier, op8_url_filters, op9_embedding_near_dedup, op10_mix_sources, op11_ranked_search, op12_source_divergence, op13_nearest_neighbours)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": OP4_SQL, "op6_document_fingerprints": OP6_SQL, "op8_url_filters": OP8_SQL, "op11_ranked_search": OP11_SQL, "op12_source_divergence": OP12_SQL}
