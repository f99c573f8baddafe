"""Queries of this subpackage by name, and the SQL for those that SQL can express."""

from .chat_format import OP1_SQL, op1_chat_format
from .decontaminate import op8_decontaminate
from .embedding_dedup import op4_embedding_dedup
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .language_id import op7_language_id
from .merkle_manifest import OP11_SQL, op11_merkle
from .mixing import op2_mixing
from .pii import op3_pii
from .secrets import op10_secrets
from .substring_dedup import op13_substring_dedup
from .token_counts import op9_token_counts
from .toxicity import op6_toxicity
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_secrets": op10_secrets,
    "op11_merkle": op11_merkle,
    "op12_vector_codes": op12_vector_codes,
    "op13_substring_dedup": op13_substring_dedup,
}
SQL = {
    "op1_chat_format": OP1_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op11_merkle": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
}
