"""Text functions as column expressions: sentences, tokens, and fixed word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent function words that never become features.
STOP_WORDS = ["a", "and", "as", "at", "be", "by", "das", "de", "del", "dem", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "es", "et", "for", "from", "im", "in", "is", "ist", "it", "la", "las", "le", "les", "los", "mit", "of", "on", "para", "por", "que", "sich", "that", "the", "this", "to", "un", "und", "une", "von", "was", "with", "zu"]

#: Modifiers of sentiment with weights; a digit 1 or 2 after a word means that the word stands before or behind.
MODIFIERS = [
    ("ain’t", -1.0, ""), ("are not", -1.0, ""), ("aren’t", -1.0, ""), ("cannot", -1.0, ""), ("cant", -1.0, ""), ("can’t", -1.0, ""), ("could not", -1.0, ""), ("couldn’t", -1.0, ""),
    ("did not", -1.0, ""), ("didn’t", -1.0, ""), ("does not", -1.0, ""), ("doesn’t", -1.0, ""), ("do not", -1.0, ""), ("don’t", -1.0, ""), ("especially", 2.0, ""), ("far from", -1.0, ""),
    ("had not", -1.0, ""), ("hadn’t", -1.0, ""), ("has not", -1.0, ""), ("hasn’t", -1.0, ""), ("have not", -1.0, ""), ("haven’t", -1.0, ""), ("is not", -1.0, ""), ("isn’t", -1.0, ""),
    ("least", -1.0, "at1"), ("less", 0.5, ""), ("neither", -1.0, ""), ("never", -1.0, ""), ("nor", -1.0, ""), ("not", -1.0, ""), ("particularly", 2.0, ""), ("quite", 2.0, ""),
    ("rather", 2.0, "than2"), ("shan’t", -1.0, ""), ("slightly", 0.5, ""), ("somewhat", 0.5, ""), ("thoroughly", 2.0, ""), ("truly", 2.0, ""), ("very", 2.0, ""), ("was not", -1.0, ""),
    ("wasn’t", -1.0, ""), ("were not", -1.0, ""), ("weren’t", -1.0, ""), ("will not", -1.0, ""), ("won’t", -1.0, ""),
]


def phrase_words(phrase: str) -> list[str]:
    """The letter words of a modifier; an apostrophe before t joins its sides."""
    return phrase.replace("’t", "t").split(" ")


#: Phrases that become one word each before sentiment is read: modifiers of two words, and words whose caveat takes them out of the modifiers.
PHRASES = sorted({tuple(phrase_words(m)) for m, _, _ in MODIFIERS if " " in m} | {(c[:-1], m) if c.endswith("1") else (m, c[:-1]) for m, _, c in MODIFIERS if c})
#: Weights by the word that a modifier has become.
WEIGHTS = {"".join(phrase_words(m)): w for m, w, _ in MODIFIERS}

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def sentences(text: Column) -> Column:
    """Non-empty parts between . ? and !."""
    return F.filter(F.split(text, "[.?!]"), lambda s: s != "")


def clean_tokens(text: Column) -> Column:
    """Lower-case words of a text: markup out, possessives and typographic quotes out, punctuation stripped."""
    plain = F.regexp_replace(text, "<[^>]*>|&[a-z]+;", " ")
    words = F.transform(F.split(plain, "\\s+"), lambda w: F.lower(F.btrim(F.regexp_replace(w, "’s|'s|“|”", ""), F.lit(PUNCTUATION))))
    return F.filter(words, lambda w: w != "")


def letter_words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+"), lambda w: w != "")


def phrased_words(sentence: Column) -> Column:
    """Lower-case letter words, in which n't is part of its word and each of PHRASES is one word."""
    words = letter_words(F.regexp_replace(F.lower(sentence), "n['’]t", "nt"))
    text = F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")
    for p in PHRASES:
        text = F.replace(text, F.lit(f" {p[0]}  {p[1]} "), F.lit(f" {''.join(p)} "))
    return F.filter(F.split(text, " +"), lambda w: w != "")


def caveat(c: Column) -> Column:
    """`at1` -> (before, at), `than2` -> (after, than), empty -> null."""
    at = "^(.*)([12])$"
    return F.when(c.rlike(at), F.struct(F.when(F.regexp_extract(c, at, 2) == "1", "before").otherwise("after").alias("side"), F.regexp_extract(c, at, 1).alias("word")))


def simple_tag(treebank: Column) -> Column:
    """Treebank part-of-speech tags as a (adjective), v, r (adverb), n; all others are n."""
    first = F.substring(treebank, 1, 1)
    return F.when(first == "J", "a").when(first == "V", "v").when(first == "R", "r").otherwise("n")
