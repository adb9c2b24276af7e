"""Token costs.

The default counter is a regular expression over letters, digits and punctuation. It is a
deterministic stand-in for a model tokenizer, not calibrated against one. Tokens never
cross a line break, so the cost of several lines is the sum of their costs; a line break
itself costs one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Up to six letters, up to three digits, or one other visible character (fixed value).
TOKEN_PATTERN = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"


def token_count(text: Column | str) -> Column:
    """Tokens in ``text``; evaluated inside the JVM."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN_PATTERN))


def token_count_sql(text: str) -> str:
    return f"regexp_count({text}, r'{TOKEN_PATTERN}')"


def text_cost_sql(text: str) -> str:
    """Tokens of a text of several lines plus one per line break."""
    return f"({token_count_sql(text)} + length({text}) - length(replace({text}, '\\n', '')))"
