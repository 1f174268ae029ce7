"""Words between ASCII white space, as SQL."""

SPACE = r"[\\x20\\x09-\\x0D]"
WORD = r"[^\\x20\\x09-\\x0D]+"


def count_words(text: str = "text") -> str:
    """SQL for the number of words (long) of a column; a null text has none."""
    return f"cast(coalesce(regexp_count({text}, '{WORD}'), 0) as long)"
