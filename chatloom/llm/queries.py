"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import line_dedup, line_rules, merkle, mixing, mtree, packing, pitman_yor, quality, simhash, url_filter

QUERIES = {
    "op1_merkle": merkle.op1_merkle,
    "op2_pitman_yor": pitman_yor.op2_pitman_yor,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_mtree": mtree.op5_mtree,
    "op6_quality": quality.op6_quality,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_packing": packing.op9_packing,
    "op10_line_rules": line_rules.op10_line_rules,
}

ORACLES = {"op1_merkle": merkle.ORACLE, "op5_mtree": mtree.ORACLE, "op7_line_dedup": line_dedup.ORACLE}
