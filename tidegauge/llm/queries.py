"""The numbered operators' queries by name, and DuckDB SQL for those that it can express."""

from tidegauge.llm import best_fit, bpe_reuse, exact_dedup, hyper_minhash, impact_topk, importance, language, periodic, secrets, sentence_spans, tool_calls, toxicity, warc

QUERIES = {
    "op1_warc_captures": warc.query,
    "op2_best_fit_packing": best_fit.query,
    "op3_impact_topk": impact_topk.query,
    "op4_tool_calls": tool_calls.query,
    "op5_toxicity": toxicity.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_hyper_minhash": hyper_minhash.query,
    "op8_bpe_chunk_reuse": bpe_reuse.query,
    "op9_secret_scan": secrets.query,
    "op10_sentence_spans": sentence_spans.query,
    "op11_importance_resampling": importance.query,
    "op12_periodic_runs": periodic.query,
    "op13_language_id": language.query,
}
ORACLES = {"op1_warc_captures": warc.ORACLE, "op3_impact_topk": impact_topk.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE}
