"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from corvid.llm import chat_format, collocations, merkle, quality_rules, substring_dedup, url_filter
from corvid.llm.chat_format import op4_chat_format
from corvid.llm.collocations import op12_collocations
from corvid.llm.decontaminate import op8_decontamination
from corvid.llm.license_rules import op6_license_rules
from corvid.llm.merkle import op13_merkle_manifest
from corvid.llm.ngram_model import op10_ngram_model
from corvid.llm.packing import op7_packing
from corvid.llm.pii import op2_pii
from corvid.llm.quality_classifier import op9_quality_classifier
from corvid.llm.quality_rules import op3_quality_rules
from corvid.llm.simhash import op1_simhash_groups
from corvid.llm.substring_dedup import op5_substring_dedup
from corvid.llm.url_filter import op11_url_filter


def queries() -> dict:
    return {
        "op1_simhash_groups": op1_simhash_groups,
        "op2_pii": op2_pii,
        "op3_quality_rules": op3_quality_rules,
        "op4_chat_format": op4_chat_format,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_license_rules": op6_license_rules,
        "op7_packing": op7_packing,
        "op8_decontamination": op8_decontamination,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_ngram_model": op10_ngram_model,
        "op11_url_filter": op11_url_filter,
        "op12_collocations": op12_collocations,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE,
        "op4_chat_format": chat_format.ORACLE,
        "op5_substring_dedup": substring_dedup.ORACLE,
        "op11_url_filter": url_filter.ORACLE,
        "op12_collocations": collocations.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
