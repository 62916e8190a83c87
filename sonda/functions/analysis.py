"""Text analysis: lower case, Unicode words, English stop words removed."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by the rules of Unicode word boundaries for alphabetic scripts: letters and digits hold together, as do letters
#: around one of ' \u2019 . : \u00b7 and digits around one of . , ; ' \u2019; so "don't" and "3.14" are one word each.
PATTERN = r"(?:[\p{L}\p{M}]+(?:['\u2019.:\u00b7][\p{L}\p{M}]+)*|\p{N}+(?:[.,;'\u2019]\p{N}+)*|_)+".replace("\\u2019", "\u2019").replace("\\u00b7", "\u00b7")
#: The same without steps back, so that long words need no stack.
POSSESSIVE = PATTERN.replace(")*", ")*+")[:-1] + "++"
#: The English stop words of the Snowball project.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing would should could ought i'm you're he's she's it's we're they're i've you've we've they've i'd you'd he'd she'd "
    "we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't "
    "wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's "
    "a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only own same so than too very"
).split()


def cut(lower: Column) -> Column:
    """All terms of a text in lower case."""
    words = F.regexp_extract_all(lower, F.lit(POSSESSIVE), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def tokens(text: Column) -> Column:
    """All terms of a text with repetitions, in order; null for null."""
    return cut(F.lower(text))


def terms(text: str) -> list[str]:
    """The distinct terms of a query, in order."""
    return list(dict.fromkeys(w for w in regex.findall(PATTERN, text.lower()) if w not in STOP_WORDS))
