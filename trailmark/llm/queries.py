"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .op1_suffix_dedup import op1_suffix_dedup
from .op10_decontaminate import op10_decontaminate
from .op11_vector_codes import OP11_SQL, op11_vector_codes
from .op12_divergence import OP12_SQL, op12_divergence
from .op13_topk import OP13_SQL, op13_topk
from .op2_near_dedup import OP2_SQL, op2_near_dedup
from .op3_chat import OP3_SQL, op3_chat
from .op4_langid import op4_langid
from .op5_sharding import op5_sharding
from .op6_mixing import op6_mixing
from .op7_quality import OP7_SQL, op7_quality
from .op8_countmin_dedup import OP8_SQL, op8_countmin_dedup
from .op9_url_filter import op9_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_chat": op3_chat,
    "op4_langid": op4_langid,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_countmin_dedup": op8_countmin_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_vector_codes": op11_vector_codes,
    "op12_divergence": op12_divergence,
    "op13_topk": op13_topk,
}
SQL: dict[str, str] = {"op2_near_dedup": OP2_SQL, "op3_chat": OP3_SQL, "op7_quality": OP7_SQL, "op8_countmin_dedup": OP8_SQL, "op11_vector_codes": OP11_SQL, "op12_divergence": OP12_SQL, "op13_topk": OP13_SQL}
