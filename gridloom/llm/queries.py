"""Queries and DuckDB SQL of the text operators, by name."""

from __future__ import annotations

from . import op1_mixing as mixing
from . import oracle
from .op1_mixing import op1_mixing
from .op2_token_counts import op2_token_counts
from .op3_media_columns import op3_media_columns
from .op4_bpe_codec import op4_bpe_codec
from .op5_imatch import op5_imatch
from .op6_minhash_dedup import op6_minhash_dedup
from .op7_quality_lm import op7_quality_lm
from .op8_language_id import op8_language_id
from .op9_suffix_dedup import op9_suffix_dedup
from .op10_toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_media_columns, op4_bpe_codec, op5_imatch, op6_minhash_dedup, op7_quality_lm, op8_language_id, op9_suffix_dedup, op10_toxicity)}

#: The others rest on hashes, libraries or models that SQL lacks; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_mixing": oracle.mixing(mixing.BLOCK, mixing.SHARD, mixing.GROUP, mixing.STRIDE), "op6_minhash_dedup": oracle.NEAR_DUPLICATES}
