"""The queries of this subpackage and their SQL."""

from lexforge.llm import licences, mixture, oracles
from lexforge.llm.decontamination import op2_decontaminate
from lexforge.llm.language import op7_language
from lexforge.llm.licences import op8_licences
from lexforge.llm.mixture import op1_mix_sources
from lexforge.llm.near_duplicates import op4_near_duplicates
from lexforge.llm.pseudonyms import op3_pseudonyms
from lexforge.llm.quality import op10_quality
from lexforge.llm.ranked_search import op5_ranked_search
from lexforge.llm.suffix_dedup import op6_suffix_dedup
from lexforge.llm.wrappers import op9_main_text


def queries():
    found = (op1_mix_sources, op2_decontaminate, op3_pseudonyms, op4_near_duplicates, op5_ranked_search, op6_suffix_dedup, op7_language, op8_licences, op9_main_text, op10_quality)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op1_mix_sources": mixture.oracle(), "op2_decontaminate": oracles.DECONTAMINATION, "op4_near_duplicates": oracles.NEAR_DUPLICATES, "op6_suffix_dedup": oracles.SUFFIX_DEDUP, "op8_licences": licences.oracle()}
