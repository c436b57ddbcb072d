"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import OP7_SQL, op7_chat_format
from .decontaminate import op6_decontamination
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_id import op2_language_id
from .license_scan import OP12_SQL, op12_license_scan
from .line_dedup import OP1_SQL, op1_line_dedup
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import op9_mixing
from .near_dup import OP5_SQL, op5_ngram_jaccard
from .quality_rules import op4_quality_rules
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .toxicity import op3_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_toxicity, op4_quality_rules, op5_ngram_jaccard, op6_decontamination, op7_chat_format, op8_substring_dedup, op9_mixing, op10_warc, op11_hard_negatives, op12_license_scan, op13_merkle_manifest)}
SQL = {"op1_line_dedup": OP1_SQL, "op5_ngram_jaccard": OP5_SQL, "op7_chat_format": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op10_warc": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_license_scan": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
