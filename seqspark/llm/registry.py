"""Queries of this subpackage; __spark_entry__.py adds them where it is present."""

from __future__ import annotations

from . import bitsliced, decontaminate, suffix_dedup
from .bitsliced import op2_exact_top_k
from .bloom_lm import op1_lm_scoring
from .decontaminate import op3_decontamination
from .html_text import op10_html_extraction
from .langid import op5_language_id
from .minhash import op9_minhash_near_dedup
from .packing import op7_harmonic_packing
from .pii import op6_pii
from .secrets import op8_secret_scan
from .suffix_dedup import op4_suffix_dedup


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_lm_scoring": op1_lm_scoring,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_decontamination": op3_decontamination,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_language_id": op5_language_id,
        "op6_pii": op6_pii,
        "op7_harmonic_packing": op7_harmonic_packing,
        "op8_secret_scan": op8_secret_scan,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_html_extraction": op10_html_extraction,
        "decontamination_proximity": decontaminate.decontamination_proximity,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {
        "op2_exact_top_k": bitsliced.ORACLE,
        "op3_decontamination": decontaminate.ORACLE,
        "op4_suffix_dedup": suffix_dedup.ORACLE,
    }
