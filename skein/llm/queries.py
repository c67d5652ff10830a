"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .chat_format import OP6_SQL, op6_chat_format
from .decontamination import op4_decontamination
from .importance import OP13_SQL, op13_importance
from .jaccard_join import OP10_SQL, op10_jaccard_join
from .language_id import op1_language_id
from .license_scan import op9_license_scan
from .mixing import OP3_SQL, op3_source_mix
from .name_join import OP11_SQL, op11_name_join
from .quality import op5_quality
from .secret_scan import op8_secret_scan
from .simhash import op12_simhash
from .toxicity import op7_toxicity
from .vp_search import op2_vp_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_vp_search, op3_source_mix, op4_decontamination, op5_quality,
        op6_chat_format, op7_toxicity, op8_secret_scan, op9_license_scan, op10_jaccard_join,
        op11_name_join, op12_simhash, op13_importance,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_source_mix": OP3_SQL, "op6_chat_format": OP6_SQL, "op10_jaccard_join": OP10_SQL, "op11_name_join": OP11_SQL, "op13_importance": OP13_SQL}
