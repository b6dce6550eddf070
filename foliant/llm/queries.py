"""The registered queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from .ann import op6_ann
from .bpe import op10_bpe
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .license_scan import op3_license_scan
from .packing import op7_packing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .pu_quality import op2_pu_quality
from .quality_rules import OP8_SQL, op8_quality_rules
from .sharding import op9_sharding
from .simhash import op1_simhash
from .suffix_dedup import op4_suffix_dedup
from .token_counts import op12_token_counts
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pu_quality": op2_pu_quality,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_ann": op6_ann,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {"op5_url_filter": OP5_SQL, "op8_quality_rules": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_conversation_repair": OP13_SQL}
