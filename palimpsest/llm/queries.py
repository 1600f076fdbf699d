"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from .bpe import op1_byte_bpe
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .fingerprints import op6_fingerprints
from .licenses import op4_license_scan
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import op2_mix_sources
from .near_dedup import op8_near_dedup
from .packing import op9_pack_tokens
from .sharding import op7_shards
from .toxicity import op10_toxicity

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_shards": op7_shards,
    "op8_near_dedup": op8_near_dedup,
    "op9_pack_tokens": op9_pack_tokens,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
}
