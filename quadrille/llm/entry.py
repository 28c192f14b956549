"""Queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from .divergence import OP13_SQL, op13_divergence
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .language import op9_language
from .lm import op4_lm_score
from .mixing import op10_mixing
from .near_dedup import op8_near_dedup
from .nearest import op3_nearest
from .negatives import OP12_SQL, op12_hard_negatives
from .sentencepiece import op1_sentencepiece
from .sharding import OP7_SQL, op7_sharding
from .simhash import op11_simhash
from .token_store import op2_token_store
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_store": op2_token_store,
    "op3_nearest": op3_nearest,
    "op4_lm_score": op4_lm_score,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_sharding": op7_sharding,
    "op8_near_dedup": op8_near_dedup,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_simhash": op11_simhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_divergence": op13_divergence,
}
ORACLES = {"op5_exact_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op7_sharding": OP7_SQL, "op12_hard_negatives": OP12_SQL, "op13_divergence": OP13_SQL}
