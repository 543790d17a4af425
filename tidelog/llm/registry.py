"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidelog.llm import ann, chat, html_text, license_scan, ngram_join, packing, quality, sentence_piece, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_chat_format": chat.op2_chat_format,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc": warc.op6_warc,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_html_text": html_text.op8_html_text,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_sentencepiece": sentence_piece.op10_sentencepiece,
}

#: Learnt, tokenised, graph-searched and parsed results are tested against brute force instead.
SQL = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
}
