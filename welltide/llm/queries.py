"""The registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from welltide.llm import ann, bpe, chat, exact, kmeans, langid, licences, maxent, mixing, negatives, shards, simhash, urls

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_url_filter": urls.op2_url_filter,
    "op3_shards": shards.op3_shards,
    "op4_chat_rotation": chat.op4_chat_rotation,
    "op5_language_id": langid.op5_language_id,
    "op6_simhash": simhash.op6_simhash,
    "op7_bpe": bpe.op7_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_licences": licences.op9_licences,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_negatives": negatives.op11_negatives,
    "op12_clusters": kmeans.op12_clusters,
    "op13_maxent": maxent.op13_maxent,
}

#: The others need an approximate search, XXH64, CRC-32, byte pairs or a trained model, which SQL does not have.
ORACLES = {
    "op2_url_filter": urls.OP2_SQL,
    "op4_chat_rotation": chat.OP4_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_licences": licences.OP9_SQL,
    "op10_exact_dedup": exact.OP10_SQL,
    "op11_negatives": negatives.OP11_SQL,
    "op12_clusters": kmeans.OP12_SQL,
}
