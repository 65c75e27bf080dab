"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tallyspark.llm import decontam, filter_audit, flac, htmltext, langid, lmscore, mixing, pieces, simjoin, spelling, token_files, token_rollup, warc

QUERIES = {
    "op1_lm_score": lmscore.query,
    "op2_decontamination": decontam.query,
    "op3_flac": flac.query,
    "op4_html_extraction": htmltext.query,
    "op5_token_files": token_files.query,
    "op6_jaccard_join": simjoin.query,
    "op7_language_id": langid.query,
    "op8_token_counts": token_rollup.query,
    "op9_sentencepiece": pieces.query,
    "op10_warc_index": warc.query,
    "op11_spelling_variants": spelling.query,
    "op12_source_mix": mixing.query,
    "op13_filter_audit": filter_audit.query,
}
ORACLES = {
    "op2_decontamination": decontam.SQL,
    "op6_jaccard_join": simjoin.SQL,
    "op8_token_counts": token_rollup.SQL,
    "op10_warc_index": warc.SQL,
    "op12_source_mix": mixing.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
