"""Text analysis as column expressions: tokens, n-grams, lexical overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that carry no topic.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her "
    "here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that "
    "the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
#: Accented Latin letters and their plain forms, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
MISSING = "[missing text]"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters without accents and stop words; blank text is one fixed phrase."""
    full = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(MISSING)).otherwise(text)
    found = F.regexp_extract_all(folded(full), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(STOP_WORDS))


def with_bigrams(words: Column) -> Column:
    """The tokens and the pairs of neighbours, after stop words are gone."""
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(words, i), x))
    return F.concat(words, pairs)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
