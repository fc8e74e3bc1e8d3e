"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quillspark.llm.ann import op6_ann
from quillspark.llm.chat_format import OP8_SQL, op8_chat_format
from quillspark.llm.collocations import OP11_SQL, op11_collocations
from quillspark.llm.exact_topk import OP3_SQL, op3_exact_topk
from quillspark.llm.language_id import op7_language_id
from quillspark.llm.lm_scoring import op9_lm_scoring
from quillspark.llm.mixing import op10_mixing
from quillspark.llm.packing import op5_packing
from quillspark.llm.simhash import op2_simhash
from quillspark.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from quillspark.llm.toxicity import op1_toxicity
from quillspark.llm.url_filter import op12_url_filter
from quillspark.llm.vector_codes import OP13_SQL, op13_vector_codes


def queries() -> dict:
    found = [op1_toxicity, op2_simhash, op3_exact_topk, op4_substring_dedup, op5_packing, op6_ann, op7_language_id, op8_chat_format, op9_lm_scoring, op10_mixing, op11_collocations, op12_url_filter, op13_vector_codes]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op8_chat_format": OP8_SQL, "op11_collocations": OP11_SQL, "op13_vector_codes": OP13_SQL}
