"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from wayline.llm import bpe_chunks, html_crf, order_minhash, pii, png_media, quality_crf, token_align, token_counts, toxicity, vector_codes, warc_zstd, wavelet, wu_manber

QUERIES = {
    "op1_ordinal_toxicity": toxicity.op1,
    "op2_html_crf": html_crf.op2,
    "op3_wavelet_store": wavelet.op3,
    "op4_order_minhash": order_minhash.op4,
    "op5_token_counts": token_counts.op5,
    "op6_png_media": png_media.op6,
    "op7_wu_manber": wu_manber.op7,
    "op8_quality_crf": quality_crf.op8,
    "op9_bpe_chunks": bpe_chunks.op9,
    "op10_boosted_pii": pii.op10,
    "op11_limb_codes": vector_codes.op11,
    "op12_dictionary_warc": warc_zstd.op12,
    "op13_lockstep_align": token_align.op13,
}

SQL: dict[str, str] = {
    "op7_wu_manber": wu_manber.OP7_SQL,
    "op12_dictionary_warc": warc_zstd.OP12_SQL,
}
