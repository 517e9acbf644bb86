"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from loomspan.llm import bpe, chat, decontaminate, language, mixing, neardup, neighbours, pii, prefixes, ranked, substrings, tokens, urls

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_pii": pii.op3_pii,
    "op4_repeats": substrings.op4_repeats,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_language_id": language.op7_language_id,
    "op8_url_filter": urls.op8_url_filter,
    "op9_token_ids": tokens.op9_token_ids,
    "op10_mixing": mixing.op10_mixing,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_prefix_trie": prefixes.op12_prefix_trie,
    "op13_bpe": bpe.op13_bpe,
}

ORACLES = {"op1_chat_format": chat.ORACLE, "op2_decontamination": decontaminate.ORACLE, "op4_repeats": substrings.ORACLE, "op8_url_filter": urls.ORACLE, "op10_mixing": mixing.ORACLE, "op11_ranked_search": ranked.ORACLE, "op12_prefix_trie": prefixes.ORACLE}
