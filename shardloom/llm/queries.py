"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .chat import OP4_SQL, op4_chat_formatting
from .decontaminate import OP10_SQL, op10_benchmark_decontamination
from .embedding_dedup import OP5_SQL, op5_embedding_near_dedup
from .html_text import op9_html_extraction
from .minhash_dedup import OP8_SQL, op8_minhash_near_dedup
from .mixing import op7_mixing
from .quality import op2_quality_classifier
from .sharding import op6_sharding
from .token_files import op3_token_files
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_files": op3_token_files,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op5_embedding_near_dedup": OP5_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
}
