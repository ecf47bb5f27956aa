"""Registered queries of the subpackage and their SQL."""

from . import embeddings, minhash, repeats, urls
from .contamination import op4_benchmark_leaks
from .embeddings import op7_embedding_links
from .minhash import op2_near_duplicates
from .mixing import op10_mix_sources
from .pii import op6_personal_data
from .quotes import op9_quoted_conversations
from .repeats import op5_repeated_passages
from .sharding import op8_kd_shards
from .toxicity import op1_toxicity
from .urls import op3_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_near_duplicates, op3_url_filter, op4_benchmark_leaks, op5_repeated_passages,
        op6_personal_data, op7_embedding_links, op8_kd_shards, op9_quoted_conversations, op10_mix_sources,
    )
}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": minhash.oracle(), "op3_url_filter": urls.oracle(), "op5_repeated_passages": repeats.oracle(), "op7_embedding_links": embeddings.oracle()}
