"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup
from .bpe import op1_byte_bpe
from .decontaminate import op6_decontaminate
from .exact_dedup import op8_exact_dedup
from .licenses import op5_license_scan
from .sharding import op4_sharding
from .quality import op9_quality
from .simhash import op2_simhash_dedup
from .suffix_dedup import op10_suffix_dedup
from .token_counts import op7_token_counts
from .toxicity import op3_toxicity


def queries() -> dict:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_sharding": op4_sharding,
        "op5_license_scan": op5_license_scan,
        "op6_decontaminate": op6_decontaminate,
        "op7_token_counts": op7_token_counts,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_quality": op9_quality,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": decontaminate.SQL, "op8_exact_dedup": exact_dedup.SQL}
