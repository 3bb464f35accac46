"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .collocations import OP12_SQL, op12_collocations
from .exact_dedup import OP11_SQL, op11_exact_dedup
from .html_extract import op8_html
from .jaccard import OP2_SQL, op2_jaccard
from .language_id import op4_language
from .licenses import op7_licenses
from .media import op10_media
from .mixing import OP1_SQL, op1_mixing
from .pii import op6_pii
from .quality_model import op9_quality
from .quality_rules import OP3_SQL, op3_quality_rules
from .token_alignment import op13_alignment

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_jaccard": op2_jaccard,
    "op3_quality_rules": op3_quality_rules,
    "op4_language": op4_language,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_html": op8_html,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}

ORACLES = {"op1_mixing": OP1_SQL, "op2_jaccard": OP2_SQL, "op3_quality_rules": OP3_SQL, "op11_exact_dedup": OP11_SQL, "op12_collocations": OP12_SQL}
