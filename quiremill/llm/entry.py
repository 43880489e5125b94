"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .chat import ORACLE_SQL as CHAT_SQL
from .chat import op1_token_level_chat
from .media import op3_netpbm_media
from .mixing import ORACLE_SQL as MIXING_SQL
from .mixing import op12_source_mixing
from .packing import op9_nnls_packing
from .periods import ORACLE_SQL as PERIODS_SQL
from .periods import op11_periodic_runs
from .quality import op2_attention_mil_quality
from .sharding import op7_rendezvous_sharding
from .simhash import op4_simhash_deletion_variants
from .sketch import op5_threshold_scaled_sketch
from .tokenfile import op10_elias_fano_token_file
from .toxicity import op6_noisy_channel_toxicity
from .trie import ORACLE_SQL as TRIE_SQL
from .trie import op13_prefix_trie

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_level_chat,
        op2_attention_mil_quality,
        op3_netpbm_media,
        op4_simhash_deletion_variants,
        op5_threshold_scaled_sketch,
        op6_noisy_channel_toxicity,
        op7_rendezvous_sharding,
        op8_byte_bpe,
        op9_nnls_packing,
        op10_elias_fano_token_file,
        op11_periodic_runs,
        op12_source_mixing,
        op13_prefix_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_token_level_chat": CHAT_SQL,
    "op11_periodic_runs": PERIODS_SQL,
    "op12_source_mixing": MIXING_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
