"""Registered queries of this subpackage and the SQL of those that SQL expresses."""

from __future__ import annotations

from keelson.llm import mixing, quality_rules, secret_scan, url_filter
from keelson.llm.decontam import op2_decontamination
from keelson.llm.line_dedup import op6_line_dedup
from keelson.llm.mixing import op5_mixing
from keelson.llm.near_dup import op9_simhash_near_dup
from keelson.llm.quality_classifier import op3_quality_classifier
from keelson.llm.quality_rules import op7_quality_rules
from keelson.llm.secret_scan import op10_secret_scan
from keelson.llm.sharding import op8_sharding
from keelson.llm.suffix_tree_lm import op4_suffix_tree_lm
from keelson.llm.url_filter import op1_url_filter

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_decontamination, op3_quality_classifier, op4_suffix_tree_lm, op5_mixing, op6_line_dedup, op7_quality_rules, op8_sharding, op9_simhash_near_dup, op10_secret_scan)}

ORACLE_SQL: dict[str, str] = {
    op1_url_filter.__name__: url_filter.ORACLE_SQL,
    op5_mixing.__name__: mixing.ORACLE_SQL,
    op7_quality_rules.__name__: quality_rules.ORACLE_SQL,
    op10_secret_scan.__name__: secret_scan.ORACLE_SQL,
}
