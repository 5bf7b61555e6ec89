"""String functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that carry no topic.
STOP_WORDS = tuple(
    (
    "a about above after again against all am an and any are as at be because been before being below between both "
    "but by cannot could did do does doing down during each few for from further had has have having he her here "
    "hers herself him himself his how i if in into is it its itself me more most my myself no nor not of off on "
    "once only or other ought our ours ourselves out over own same she should so some such than that the their "
    "theirs them themselves then there these they this those through to too under until up very was we were what "
    "when where which while who whom why with would you your yours yourself yourselves"
    ).split()
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def replace_non_word(text: Column, by: str = " ", ascii_only: bool = False) -> Column:
    """Keeps letters, digits and underscores."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]" if ascii_only else r"[^\p{L}\p{Nd}_]", by)


def tokens(text: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
