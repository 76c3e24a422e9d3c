"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tickloom.llm import audit, decontamination, language, mixing, pii, quality, secrets, sharding, simhash, suffixes, token_output, treap, warc

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_rake_mixture,
        decontamination.op2_simhash_decontamination,
        pii.op3_weak_supervision_pii,
        suffixes.op4_suffix_dedup,
        warc.op5_warc_transactions,
        quality.op6_mcd_outliers,
        token_output.op7_orc_token_output,
        language.op8_ecoc_language_id,
        sharding.op9_hypergeometric_sharding,
        simhash.op10_simhash_near_duplicates,
        treap.op11_k2_treap_search,
        audit.op12_retraction_stream_audit,
        secrets.op13_token_efficiency_secrets,
    )
}
SQL = {"op5_warc_transactions": warc.OP5_SQL, "op11_k2_treap_search": treap.OP11_SQL, "op12_retraction_stream_audit": audit.OP12_SQL}
