"""Cleaning of social posts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The word class is spelled out because Java's also counts combining marks, which Python's does not.
# Spaces are Unicode's (?U); Python counts four control characters as well, see `_spaced`.
_WORD = r"[\p{L}\p{N}_]"
_SEPARATORS = r"[\x1c-\x1f]"

# What is cut out of a post, in this order. The expensive classes come after a literal,
# so most characters of a text are passed over by a plain search.
URL = r"(?U)http\S+"
MENTION = "@" + _WORD + "+"
RETWEET = f"RT(?!{_WORD})(?<!{_WORD}RT)"
SPACES = r"(?U)\s+"


def _spaced(c: Column) -> Column:
    """File, group, record and unit separators as plain spaces; hardly any text has them."""
    return F.when(c.rlike(_SEPARATORS), F.regexp_replace(c, _SEPARATORS, " ")).otherwise(c)


def unescape_html(c: Column) -> Column:
    """Decode HTML entities. Only texts with an ampersand go to Python, as Arrow batches."""

    @F.arrow_udf("string")
    def decode(texts: pa.Array) -> pa.Array:
        from html import unescape

        # A few texts at a time are Python strings, whatever the size of the batch.
        parts = (texts.slice(i, 32).to_pylist() for i in range(0, len(texts), 32))
        done = [pa.array([None if t is None else unescape(t) for t in part], pa.string()) for part in parts]
        return pa.concat_arrays([pa.array([], pa.string()), *done])

    return F.coalesce(decode(F.when(c.contains("&"), c)), c)


def clean_text(c: Column | str, entities: bool = True) -> Column:
    """Entities decoded, links, mentions and the retweet mark removed, tags kept as words, spaces
    collapsed; no text gives an empty one."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    if entities:
        text = unescape_html(text)
    text = _spaced(text)
    for pattern in (URL, MENTION, RETWEET):
        text = F.regexp_replace(text, pattern, "")
    text = F.replace(text, F.lit("#"), F.lit(""))
    return F.trim(F.regexp_replace(text, SPACES, " "))
