"""What the features count in a text, in tasks.

Python's regular expressions are many times faster here than a chain of array expressions.  They mean the same as the JVM's on
plain texts: Latin letters up to U+017F and usual marks, without characters that the two class differently.  A text with any
other character has no counts here; expressions measure it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import functions as F

from . import lexicons as lex
from . import text as T

#: Not plain: separators U+1C to U+1F, superscripts and fractions, letters whose lower case is in another class, and all beyond.
OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0132-\u0148\u014a-\u0177\u0179-\u017e\u2013\u2014\u2018-\u201d\u2022\u2026\u20ac]")
FEATURE_WORD = re.compile(T.FEATURE_WORD.removeprefix("(?U)"))
#: T.NUMBER and T.DIALOGUE with what comes before them said after their first character, by which they are found faster.
NUMBER = re.compile(r"[0-9](?<!\w[0-9])[0-9]*(?:[.,][0-9]+)?\b")
FEATURE_SENTENCE = re.compile("[^.!?…]+[.!?…]*")
#: The builder's tokens with a letter: its digits never join them.
BUILDER_WORD = re.compile(rf"[{T.LATIN}]+(?:[-'][{T.LATIN}]+)?")
BUILDER_CUT = re.compile(r"(?<=[.!?…])\s+")
DIALOGUE = re.compile(r"[—-](?<!\S[—-])\s*[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ]")
BUILDER_MARKS = ",;:!?—-()"


def hits(found: Counter, words: frozenset) -> int:
    return sum(found[w] for w in found.keys() & words)


@lru_cache(None)
def lexicon(name: str, folded: bool = False) -> frozenset:
    return frozenset(T.folded(getattr(lex, name)) if folded else getattr(lex, name))


@lru_cache(1)
def bases() -> bytes:
    """Letters of Latin-1 without their accents."""
    plain = dict(zip(*T.accent_map()))
    return "".join(plain.get(chr(i), chr(i)) for i in range(256)).encode("latin-1")


@lru_cache(1)
def word_bytes() -> bytes:
    """Letters, digits and joining marks of Latin-1 as they are, a full stop for what ends a sentence, a blank for the rest."""
    return bytes(i if FEATURE_WORD.fullmatch(chr(i)) or chr(i) in "-'" else ord("." if chr(i) in ".!?" else " ") for i in range(256))


@lru_cache(None)
def latin(name: str) -> frozenset:
    return frozenset(w.encode("latin-1") for w in lexicon(name) if max(w) < "\u0100")


@lru_cache(1)
def latin_punctuation() -> bytes:
    return "".join(c for c in set(lex.PUNCTUATION) if c < "\u0100").encode("latin-1")


def latin_sentences(t: str, low: str) -> tuple[bytes, list[list[bytes]]] | None:
    """A text in Latin-1 and the words of its sentences, which bytes are much faster for; none where a word may end beside a sign that isn't a word's."""
    try:
        raw = t.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if WITHIN.search(raw):
        return None
    plain = low.encode("latin-1").translate(word_bytes())
    if b"-" in plain or b"'" in plain:
        plain = UNJOINED.sub(b" ", plain)
    return raw, [p.split() for p in plain.split(b".")]


#: What \w has beyond the words' letters; joining marks that don't stand between two letters or digits.
WITHIN = re.compile(b"[_\xaa\xb5\xba]")
UNJOINED = re.compile(rb"(?<![^ .'-])[-']+|[-'](?![^ .'-])")


def linguistic(text: str, long_word: int) -> tuple:
    t = text.strip()
    low = t.lower()
    # words have no mark that ends a sentence, so those of all sentences are those of the text
    parts = [p for p in FEATURE_SENTENCE.findall(low) if not p.isspace()]
    fast = latin_sentences(t, low)
    found = [FEATURE_WORD.findall(p) for p in parts] if fast is None else fast[1]
    sizes = [len(f) for f in found if f]
    words = list(chain.from_iterable(found))
    known = lexicon if fast is None else latin
    punctuation = sum(map(t.count, set(lex.PUNCTUATION))) if fast is None else len(t) - len(fast[0].translate(None, latin_punctuation()))
    mean, squares = sum(sizes) / max(len(sizes), 1), 0.0
    for x in sizes:
        squares += (x - mean) * (x - mean)
    lengths, by = list(map(len, words)), Counter(words)
    return (
        len(t), len(words), len(parts) or int(t != ""), sum(lengths), max(sizes, default=0), len(sizes), squares, len(by), sum(map(long_word.__le__, lengths)), list(by.values()).count(1),
        punctuation, len(NUMBER.findall(t)), hits(by, known("CONNECTIVES")), hits(by, known("SUBORDINATION_MARKERS")), hits(by, known("FUNCTION_WORDS")),
    )


def builder(text: str) -> tuple:
    words = BUILDER_WORD.findall(text)
    words = unaccented(" ".join(words).lower()).split(" ") if words else []
    by = Counter(words)
    # a token has no white space, so no sentence cuts one
    return (
        len(text), len(words), sum(not p.isspace() for p in BUILDER_CUT.split(text) if p), len(words), len(by), sum(map(BUILDER_LONG.__le__, map(len, words))), hits(by, lexicon("SUBORDINATION", True)), hits(by, lexicon("DISCOURSE", True)),
        sum(map(text.count, BUILDER_MARKS)), hits(by, lexicon("ABSTRACT", True)), hits(by, lexicon("AMBIGUITY", True)), hits(by, lexicon("TEMPORAL", True)), int(DIALOGUE.search(text) is not None),
    )


def unaccented(text: str) -> str:
    if text.isascii():
        return text
    try:
        return text.encode("latin-1").translate(bases()).decode("latin-1")
    except UnicodeEncodeError:
        return text.translate(accents())


@lru_cache(1)
def accents() -> dict:
    return str.maketrans(*T.accent_map())


def window(text: str) -> tuple:
    words = BUILDER_WORD.findall(text)
    words = unaccented(" ".join(words).lower()).split(" ") if words else []
    stops = lexicon("STOPWORDS")
    folded = unaccented(text.lower())
    return (
        len(text), len(words), sum(not p.isspace() for p in BUILDER_CUT.split(text) if p), sum(map(len, LETTERS.findall(text))), sum(map(stops.__contains__, words)), int(any(p in folded for p in lex.EDITORIAL)),
    )


BUILDER_LONG = 8
LETTERS = re.compile(r"[^\W\d_]+")
COUNTS = {
    window: ["chars", "words", "sentences", "letters", "stopwords", "noise"],
    linguistic: ["chars", "words", "sentences", "letters", "longest", "counted", "squares", "distinct", "long", "alone", "punctuation", "numbers", "connectives", "subordination", "function"],
    builder: ["chars", "words", "sentences", "in_sentences", "distinct", "long", "subordination", "discourse", "punctuation", "abstract", "ambiguity", "temporal", "dialogue"],
}


def udf_of(of, **parameters):
    """The counts of `of` as a struct, none for texts that aren't plain."""
    types = {name: pa.float64() if name == "squares" else pa.int32() for name in COUNTS[of]}
    own = pa.struct(list(types.items()))

    def counts(texts: pa.Array) -> pa.Array:
        rows = [None if t is None or OTHER.search(t) else of(t, **parameters) for t in texts.to_pylist()]
        none = pa.array([r is None for r in rows])
        empty = (0,) * len(types)
        columns = zip(*(r or empty for r in rows)) if rows else ((),) * len(types)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], fields=list(own), mask=none)

    counts.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(counts, "struct<" + ", ".join(f"{k}: {'double' if k == 'squares' else 'int'}" for k in types) + ">")
