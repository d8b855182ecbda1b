"""The corpus queries and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, langid, minhash_dedup, mixing, packing, shards, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_minhash_dedup": minhash_dedup.op2_minhash_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_langid": langid.op4_langid,
    "op5_mixing": mixing.op5_mixing,
    "op6_shards": shards.op6_shards,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_packing": packing.op8_packing,
    "op9_warc": warc.op9_warc,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.SQL, "op5_mixing": mixing.SQL, "op7_url_filter": url_filter.SQL, "op9_warc": warc.SQL}
