"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .decontaminate import op12_winnow_decontaminate
from .embedding_dedup import op6_embedding_dedup
from .fill_middle import op13_fill_in_middle
from .html_text import op8_html_text
from .jaccard_join import op5_jaccard_join
from .language_model import op7_maxent_score
from .mixing import ORACLE as OP2_SQL
from .mixing import op2_mix_to_weights
from .oracles import OP5, OP6, OP9, OP11, OP12, OP13
from .packing import op4_best_fit_packing
from .quality_model import op1_site_quality
from .quality_rules import op9_host_rules
from .secrets import op10_secret_scan
from .token_files import op3_token_orc
from .vector_codes import op11_vector_codes

QUERIES = {
    "op1_site_quality": op1_site_quality,
    "op2_mix_to_weights": op2_mix_to_weights,
    "op3_token_orc": op3_token_orc,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_maxent_score": op7_maxent_score,
    "op8_html_text": op8_html_text,
    "op9_host_rules": op9_host_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_winnow_decontaminate": op12_winnow_decontaminate,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {"op2_mix_to_weights": OP2_SQL, "op5_jaccard_join": OP5, "op6_embedding_dedup": OP6, "op9_host_rules": OP9, "op11_vector_codes": OP11, "op12_winnow_decontaminate": OP12, "op13_fill_in_middle": OP13}
