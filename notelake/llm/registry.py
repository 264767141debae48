"""The subpackage's queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from notelake.llm.decontaminate import OP8_SQL, op8_decontaminate
from notelake.llm.embedding_dedup import op11_embedding_dedup
from notelake.llm.html_extract import op9_html_extract
from notelake.llm.license_scan import op2_license_scan
from notelake.llm.line_dedup import OP3_SQL, op3_line_dedup
from notelake.llm.lm_scoring import op6_lm_scoring
from notelake.llm.ngram_join import op7_ngram_join
from notelake.llm.packing import op1_packing
from notelake.llm.quality import op4_quality_rules
from notelake.llm.resampling import op12_importance_resampling
from notelake.llm.secrets import op5_secret_scan
from notelake.llm.token_counts import op10_token_counts
from notelake.llm.whitening import op13_whitening

QUERIES = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scan": op5_secret_scan,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_ngram_join": op7_ngram_join,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_extract": op9_html_extract,
    "op10_token_counts": op10_token_counts,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op8_decontaminate": OP8_SQL,
}
