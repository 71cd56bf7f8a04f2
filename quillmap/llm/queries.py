"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from . import oracles
from .decontaminate import op9_benchmark_decontamination
from .hnsw import op3_embedding_near_dedup
from .html_text import op6_html_extraction
from .language_id import op10_language_id
from .masked_lm import op2_lm_scoring
from .mixing import op4_mixing_sources
from .ngram_join import op5_ngram_jaccard_join
from .packing import op8_token_packing
from .substring_dedup import op7_substring_dedup
from .url_filter import op1_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_lm_scoring, op3_embedding_near_dedup, op4_mixing_sources, op5_ngram_jaccard_join,
        op6_html_extraction, op7_substring_dedup, op8_token_packing, op9_benchmark_decontamination, op10_language_id,
    )
}
ORACLES = {"op4_mixing_sources": oracles.MIXING, "op5_ngram_jaccard_join": oracles.NGRAM_JOIN, "op9_benchmark_decontamination": oracles.DECONTAMINATION}
