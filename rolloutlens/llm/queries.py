"""Registered queries of this subpackage; the DuckDB statement where SQL can
express the operator."""

from __future__ import annotations

from . import bpe, fingerprint, htmlmain, langid, licenses, linededup, mixing, packing, repeats, simhash, topk, toxicity, whitening

QUERIES = {
    "op1_language_id": langid.query,
    "op2_line_dedup": linededup.query,
    "op3_main_text": htmlmain.query,
    "op4_fingerprints": fingerprint.query,
    "op5_bpe": bpe.query,
    "op6_simhash": simhash.query,
    "op7_toxicity": toxicity.query,
    "op8_license_scan": licenses.query,
    "op9_topk_search": topk.query,
    "op10_packing": packing.query,
    "op11_periodic_runs": repeats.query,
    "op12_mixing": mixing.query,
    "op13_whitening": whitening.query,
}

ORACLE = {
    "op2_line_dedup": linededup.SQL,
    "op9_topk_search": topk.SQL,
    "op11_periodic_runs": repeats.SQL,
}
