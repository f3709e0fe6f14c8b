"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from sluice.llm import bpe, chat, codes, langid, manifest, minhash, mixing, quality, substrings, tokenfile, topk, toxicity, warc

QUERIES = {
    "op1_toxicity_chain": toxicity.op1_toxicity_chain,
    "op2_quality_divergence": quality.op2_quality_divergence,
    "op3_maxscore": topk.op3_maxscore,
    "op4_recompression": substrings.op4_recompression,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_language_id": langid.op6_language_id,
    "op7_minhash": minhash.op7_minhash,
    "op8_perspectives": chat.op8_perspectives,
    "op9_entropy_mix": mixing.op9_entropy_mix,
    "op10_warc": warc.op10_warc,
    "op11_gnat_codes": codes.op11_gnat_codes,
    "op12_repair_tokens": tokenfile.op12_repair_tokens,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op3_maxscore": topk.OP3_SQL,
    "op4_recompression": substrings.OP4_SQL,
    "op7_minhash": minhash.OP7_SQL,
    "op8_perspectives": chat.OP8_SQL,
    "op11_gnat_codes": codes.OP11_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
