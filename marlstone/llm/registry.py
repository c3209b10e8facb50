"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.collocations import OP12_SQL, op12_collocations
from marlstone.llm.embeddings import OP9_SQL, op9_embeddings
from marlstone.llm.language import op8_language
from marlstone.llm.lexical import OP11_SQL, op11_lexical
from marlstone.llm.mixing import OP5_SQL, op5_mixing
from marlstone.llm.near_duplicates import OP4_SQL, op4_minhash
from marlstone.llm.packing import op7_packing
from marlstone.llm.quality import op13_quality
from marlstone.llm.secrets import OP1_SQL, op1_secrets
from marlstone.llm.separators import op10_separator_scan
from marlstone.llm.sharding import op3_sharding
from marlstone.llm.topk import OP6_SQL, op6_topk
from marlstone.llm.url_filters import OP2_SQL, op2_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_url_filters,
        op3_sharding,
        op4_minhash,
        op5_mixing,
        op6_topk,
        op7_packing,
        op8_language,
        op9_embeddings,
        op10_separator_scan,
        op11_lexical,
        op12_collocations,
        op13_quality,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_secrets": OP1_SQL,
    "op2_url_filters": OP2_SQL,
    "op4_minhash": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op6_topk": OP6_SQL,
    "op9_embeddings": OP9_SQL,
    "op11_lexical": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
