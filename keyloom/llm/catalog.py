"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_collocations
from .line_dedup import OP8_SQL, op8_line_dedup
from .lm_scoring import op7_lm_scoring
from .media_columns import op10_media
from .minhash_dedup import op5_minhash_dedup
from .mixing import op1_mixing
from .passage_dedup import op8_passage_dedup
from .pii import op4_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .sentencepiece_bpe import op2_sentencepiece
from .sharding import op11_sharding
from .topk_search import OP3_SQL, op3_topk
from .toxicity import op9_toxicity
from .url_filters import OP6_SQL, op6_url_filters

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_topk": op3_topk,
    "op4_pii": op4_pii,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_line_dedup": op8_line_dedup,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_media": op10_media,
    "op11_sharding": op11_sharding,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op3_topk": OP3_SQL,
    "op6_url_filters": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op12_collocations": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
