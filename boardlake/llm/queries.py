"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from boardlake.llm import collocations, conversation_repair, credentials, decontamination, order_minhash, packing, pii, quality, simhash, token_counts, token_files, toxicity, url_filter

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_pii": pii.op2_pii,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_packing": packing.op5_packing,
    "op6_token_files": token_files.op6_token_files,
    "op7_order_minhash": order_minhash.op7_order_minhash,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality": quality.op10_quality,
    "op11_collocations": collocations.op11_collocations,
    "op12_credentials": credentials.op12_credentials,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLES = {
    "op1_decontamination": decontamination.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
