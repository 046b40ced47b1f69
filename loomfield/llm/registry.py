"""The queries on the training-data operators, and their SQL for DuckDB."""

from . import chat, quality, sharding
from .bpe import op5_bpe, op9_token_counts
from .chat import op3_chat
from .html import op10_html
from .imatch import op1_imatch
from .packing import op6_packing
from .quality import op8_quality
from .secrets import op4_secrets
from .sharding import op2_sharding
from .simhash import op7_simhash

QUERIES = {f.__name__: f for f in (op1_imatch, op2_sharding, op3_chat, op4_secrets, op5_bpe, op6_packing, op7_simhash, op8_quality, op9_token_counts, op10_html)}
#: The others aren't expressible: they need XXH64, a trained model, a tokenizer, or positions of matches.
ORACLES: dict[str, str] = {"op2_sharding": sharding.ORACLE, "op3_chat": chat.ORACLE, "op8_quality": quality.ORACLE}
