"""Queries of this subpackage, and DuckDB SQL for those that SQL can express on whole tables."""

from larkspur.llm import bpe, decontam, linededup, lmscore, minhash, quality, suffix, tokencount, urlfilter, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_warc": warc.op2_warc,
    "op3_lm_score": lmscore.op3_lm_score,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_suffix_array": suffix.op5_suffix_array,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_minhash": minhash.op9_minhash,
    "op10_quality_rules": quality.op10_quality_rules,
}

ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op4_decontaminate": decontam.OP4_SQL,
    "op8_url_filter": urlfilter.OP8_SQL,
    "op10_quality_rules": quality.OP10_SQL,
}
