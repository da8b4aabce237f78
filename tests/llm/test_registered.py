"""What this part registers, and which of its queries SQL can express."""

import __spark_entry__ as E
from retailops.llm.queries import QUERIES

#: Model fitting, hashes, tokenizers and page parsing: held against brute force in this folder.
NON_SQL = {"op1_language_id", "op2_lm_score", "op4_quality_rules", "op5_html_extract", "op6_token_file", "op7_decontaminate",
           "op8_bpe_tree", "op9_simhash_dedup", "op10_token_counts", "op12_pii", "pipeline"}


def test_all_are_registered_and_have_sql_or_a_reason():
    ours = {*QUERIES, "pipeline"}
    assert len(ours) == 14 and ours <= set(E.queries())
    assert ours - set(E.oracle_sql()) == NON_SQL
