from callgrain.functions.similarity import cosine, name_ratio
from callgrain.functions.text import (
    byte_length, keep_directions, norm_key, norm_name, norm_query, norm_text, one_line, preview,
    repair_name, tokens, trim_ws,
)

__all__ = [
    "byte_length", "cosine", "keep_directions", "name_ratio", "norm_key", "norm_name", "norm_query",
    "norm_text", "one_line", "preview", "repair_name", "tokens", "trim_ws",
]
