"""The queries opN_<name> and, where SQL can express one, its SQL."""

from __future__ import annotations

from .exact_dedup import OP8_SQL, op8_exact_dedup
from .jaccard_join import OP10_SQL, op10_jaccard
from .language_id import op2_language
from .mixing import OP1_SQL, op1_mix_sources
from .packing import op9_pack
from .quality_classifier import op4_quality
from .quality_rules import op6_quality_rules
from .secrets import op7_secrets
from .suffix_dedup import op3_repeats
from .token_files import op5_token_files

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op10_jaccard": op10_jaccard,
    "op2_language": op2_language,
    "op3_repeats": op3_repeats,
    "op4_quality": op4_quality,
    "op5_token_files": op5_token_files,
    "op6_quality_rules": op6_quality_rules,
    "op7_secrets": op7_secrets,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pack": op9_pack,
}

ORACLES = {
    "op1_mix_sources": OP1_SQL,
    "op10_jaccard": OP10_SQL,
    "op8_exact_dedup": OP8_SQL,
}
