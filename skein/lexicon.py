"""Small word lists and rules of our own, used by operators as defaults and by queries as literals."""

POSITIVE = ["the", "is", "good", "great", "la", "der"]
NEGATIVE = ["of", "bad", "sad", "de", "die"]
OBSCENE = ["idiot", "scum", "trash", "and"]
STOP = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "la", "de", "der", "die", "en", "le"]
BAD_URL_FRAGMENTS = ["blog", "/fr/", "ref="]
#: Stored equations over pos, neg and obscene.
EQUATIONS = {1: "pos - neg - 2*obscene", 2: "(pos - neg) / (pos + neg + obscene)"}
