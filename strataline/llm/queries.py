"""Queries over the training-data operators, each over its whole table."""

from __future__ import annotations

from . import alignment, ann, decontaminate, fingerprints, lines, lm, mixing, phrases, quality, secrets, simhash, substrings, toxicity

QUERIES = {
    "op1_line_dedup": lines.op1_query,
    "op2_decontaminate": decontaminate.op2_query,
    "op3_mixing": mixing.op3_query,
    "op4_neighbours": ann.op4_query,
    "op5_simhash": simhash.op5_query,
    "op6_quality": quality.op6_query,
    "op7_language_model": lm.op7_query,
    "op8_secrets": secrets.op8_query,
    "op9_toxicity": toxicity.op9_query,
    "op10_substrings": substrings.op10_query,
    "op11_alignment": alignment.op11_query,
    "op12_phrases": phrases.op12_query,
    "op13_fingerprints": fingerprints.op13_query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": lines.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op10_substrings": substrings.OP10_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
