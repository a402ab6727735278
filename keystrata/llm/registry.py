"""Queries and SQL of the corpus operators, as ``__spark_entry__`` lists them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_text, langid, mixing, pii, sharding, simhash, token_files, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op3_token_files": token_files.op3_token_files,
    "op2_sharding": sharding.op2_sharding,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_pii": pii.op5_pii,
    "op6_mixing": mixing.op6_mixing,
    "op7_html_text": html_text.op7_html_text,
    "op8_url_filter": urls.op8_url_filter,
    "op9_language_id": langid.op9_language_id,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op8_url_filter": urls.ORACLE,
}
