"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .decontamination import OP9_SQL, op9_decontamination
from .packing import op6_packing
from .quality import op3_quality
from .secrets import op10_secrets
from .sharding import OP5_SQL, op5_sharding
from .simhash import op4_simhash
from .token_counts import op2_token_counts
from .topk import OP7_SQL, op7_topk_search
from .toxicity import op1_toxicity
from .url_filter import OP11_SQL, op11_url_filter
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_topk_search": op7_topk_search,
    "op8_chat_format": op8_chat_format,
    "op9_decontamination": op9_decontamination,
    "op10_secrets": op10_secrets,
    "op11_url_filter": op11_url_filter,
    "op12_vector_codes": op12_vector_codes,
}
SQL = {"op5_sharding": OP5_SQL, "op7_topk_search": OP7_SQL, "op8_chat_format": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_url_filter": OP11_SQL, "op12_vector_codes": OP12_SQL}
