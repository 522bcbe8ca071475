"""Column-expression helpers (JVM-side, inside whole-stage codegen)."""

from quarry.functions.arrays import (attention_mask, dot, ids_text, pad_cut, strip_padding,
                                     strip_special)
from quarry.functions.keyed import gumbel_key, keyed_uniform, shuffle_key
from quarry.functions.text import TOKENIZERS, delimiter_tokens, fmt_duration, fmt_sections, tokens

__all__ = ["attention_mask", "dot", "ids_text", "pad_cut", "strip_padding", "strip_special",
           "gumbel_key", "keyed_uniform", "shuffle_key", "fmt_duration", "fmt_sections", "tokens",
           "delimiter_tokens", "TOKENIZERS"]
