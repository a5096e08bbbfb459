"""Text functions: Column in, Column out.  Everything stays in the JVM; white space and digits are Unicode's, as stated."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = rf"[{LATIN}]+(?:[-'][{LATIN}]+)?|\p{{Nd}}+"
FEATURE_WORD = rf"(?U)\b[0-9{LATIN}]+(?:[-'’][0-9{LATIN}]+)*\b"
NUMBER = r"(?U)\b\d+(?:[.,]\d+)?\b"
DIALOGUE = r"(?U)(^|\s)[—-]\s*[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ]"


@lru_cache(1)
def accent_map() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into a base letter and marks, and their bases."""
    source, target = [], []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != chr(c):
            source.append(chr(c))
            target.append(base[0])
    return "".join(source), "".join(target)


def fold_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def coerce(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    # looks no further than the first sign
    return ~coerce(c).rlike(r"(?U)\S")


def strip_accents(c: Column) -> Column:
    """Without accents; marks of already decomposed text go too.  Scripts beyond Latin keep their composed letters."""
    source, target = accent_map()
    plain = lambda t: F.octet_length(t) == F.length(t)  # noqa: E731  nothing beyond ASCII
    return once(c, lambda t: F.when(plain(t), t).otherwise(F.regexp_replace(F.translate(t, source, target), r"\p{Mn}+", "")))


def extract(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def words(c: Column) -> Column:
    """Builder's tokens: letters with one hyphen or apostrophe joint at most, or digits."""
    return extract(c, WORD)


def once(value: Column, of) -> Column:
    """`of(value)`, which may name the value several times: it is computed once."""
    return F.transform(F.array(value), of)[0]


def _folded(tokens: Column) -> Column:
    """The tokens in lower case without accents, in one pass over their joined text."""

    def of(t: Column) -> Column:
        joined = strip_accents(F.lower(F.array_join(t, " ")))
        return F.when(F.size(t) > 0, F.split(joined, " ")).otherwise(F.array().cast("array<string>"))

    return once(tokens, of)


def normalized_words(c: Column) -> Column:
    """Builder's tokens with a letter, lower case, without accents."""
    return _folded(F.filter(words(c), lambda w: w.rlike(rf"[{LATIN}]")))


def sentences(c: Column) -> Column:
    """Builder's sentences: cut after . ! ? … and white space; a text without any cut is one."""
    whole = strip(c)
    parts = F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?…])\s+"), strip), lambda s: s != "")
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(parts)


def feature_words(c: Column) -> Column:
    return extract(c, FEATURE_WORD)


def feature_sentences(c: Column) -> Column:
    """Runs without . ! ? … and the marks after them; leading marks are lost, a text of marks only is one sentence."""
    parts = F.filter(F.transform(extract(c, "[^.!?…]+[.!?…]*"), strip), lambda s: s != "")
    return F.when(strip(c) == "", F.array().cast("array<string>")).when(F.size(parts) > 0, parts).otherwise(F.array(strip(c)))


def numbers(c: Column) -> Column:
    return extract(c, NUMBER)


def count_chars(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def punctuation(c: Column) -> Column:
    return count_chars(c, lex.PUNCTUATION)


def normalize_spaces(c: Column) -> Column:
    c = F.translate(c, "﻿\r", " \n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip_boilerplate(c: Column) -> Column:
    """What follows the first start marker that occurs, up to the first end marker that occurs."""
    out = c
    for p in reversed(lex.BOILERPLATE_START):
        out = F.when(c.rlike(f"(?is){p}"), F.regexp_replace(c, f"(?is)^.*?{p}", "")).otherwise(out)
    cut = out
    for p in reversed(lex.BOILERPLATE_END):
        cut = F.when(out.rlike(f"(?is){p}"), F.regexp_replace(out, f"(?is){p}", "")).otherwise(cut)
    return cut


def has_editorial_noise(c: Column) -> Column:
    """Some pattern occurs in the folded text; patterns with accents never do."""
    return once(strip_accents(F.lower(c)), lambda t: reduce(lambda a, b: a | b, (t.contains(p) for p in lex.EDITORIAL)))


def remove_editorial_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"), strip)
    kept = F.filter(lines, lambda s: (s == "") | ~(has_editorial_noise(s) | s.rlike(r"^(?U)[\W\d_]{1,20}$")))
    return F.array_join(kept, "\n")


def normalize_text(c: Column) -> Column:
    """Audit's form: lower case, no accents, runs of other than letters, digits and _ as one blank."""
    return strip(F.regexp_replace(strip_accents(F.lower(c)), r"(?U)\W+", " "))


def stable_hash(c: Column) -> Column:
    return F.substring(F.sha1(normalize_text(c)), 1, 16)


def audit_noise(c: Column) -> Column:
    return normalize_text(c).rlike("|".join(lex.AUDIT_EDITORIAL))


def clean_for_csv(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column, normalize_whitespace: bool = True) -> Column:
    """Without control characters and outer white space.  Most texts are clean: they are only looked through."""
    as_is = coerce(c)
    edges = F.concat(F.substring(as_is, 1, 1), F.substring(as_is, -1, 1)).rlike(r"(?U)\s")
    unclean = as_is.rlike(r"[\x00-\x09\x0b-\x1f\x7f]") | edges
    c = F.regexp_replace(as_is, "\\r\\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    if normalize_whitespace:
        for found in ("  ", " \n", "\n ", "\n\n\n"):
            unclean = unclean | F.contains(as_is, F.lit(found))
        c = F.regexp_replace(c, r"[ \t\f\x0b]+", " ")
        c = F.regexp_replace(F.regexp_replace(c, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.when(unclean, strip(c)).otherwise(as_is)


def leakage_form(c: Column) -> Column:
    return strip(F.regexp_replace(strip_accents(F.lower(strip(coerce(c)))), "[^0-9a-záàâãéêíóôõúç]+", " "))


class _LeakageSigns(dict):
    """What a lower-case character is in `leakage_form`: its base, nothing for a mark, a blank for all but letters and digits."""

    def __missing__(self, code: int):
        source, target = accent_map()
        c = chr(code)
        base = target[source.index(c)] if c in source else "" if unicodedata.category(c) == "Mn" else c
        self[code] = out = base if base in LEAKAGE_SIGNS else " "  # the empty text is in any
        return out


LEAKAGE_SIGNS = "0123456789abcdefghijklmnopqrstuvwxyz"
_leakage_signs = _LeakageSigns()


def leakage_text(text: str | None) -> str:
    """`leakage_form` of one text, for tasks that go on in Python; the two may differ in marks that only one of their Unicode versions has."""
    lower = (text or "").lower()
    try:  # nearly all texts; a table of bytes is much faster than one of characters
        return b" ".join(lower.encode("latin-1").translate(_latin_signs()).split()).decode("ascii")
    except UnicodeEncodeError:
        return " ".join(lower.translate(_leakage_signs).split())


@lru_cache(1)
def _latin_signs() -> bytes:
    return "".join(_leakage_signs[c] for c in range(256)).encode("ascii")


def runs(c: Column, n: int) -> Column:
    """All runs of n characters.  The characters are an array first: a string's i-th character is only found from its start."""

    def of(chars: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(chars) - n)
        return F.when(F.size(chars) >= n, F.transform(at, lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))).otherwise(F.array().cast("array<string>"))

    # a lambda's variable is evaluated once, an expression inside of a lambda for each element
    return F.transform(F.array(F.split(c, "")), of)[0]


def char_ngrams(c: Column, n: int = 5) -> Column:
    """The distinct n-grams of the text between two blanks on each side; all of it if it has n characters at most."""
    padded = F.concat(F.lit("  "), c, F.lit("  "))
    return F.when(c == "", F.array().cast("array<string>")).when(F.length(padded) <= n, F.array(padded)).otherwise(F.array_distinct(runs(padded, n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def alpha_ratio(c: Column) -> Column:
    return ratio(F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.length(c))


def share_in(tokens: Column, lexicon: list[str]) -> Column:
    """The share of tokens that the list has, of one token at least."""
    return F.size(F.filter(tokens, lambda t: t.isin(lexicon))).cast("double") / F.greatest(F.size(tokens), F.lit(1))


def stopword_ratio(tokens: Column) -> Column:
    return share_in(tokens, lex.STOPWORDS)


def folded(lexicon: list[str]) -> list[str]:
    return sorted({fold_accents(x.lower()) for x in lexicon})


def length_bin(n: Column, bins=lex.LENGTH_BINS) -> Column:
    out = F.lit("out_of_range")
    for lo, hi in reversed(bins):
        out = F.when(n.between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return out


AUDIT_BINS = [(40, "<=40"), (80, "41-80"), (120, "81-120"), (160, "121-160"), (220, "161-220")]


def audit_length_bin(n: Column) -> Column:
    out = F.lit(">220")
    for top, name in reversed(AUDIT_BINS):
        out = F.when(n <= top, name).otherwise(out)
    return out


def group_value(c: Column) -> Column:
    return F.replace(F.lower(clean_for_csv(coerce(c))), F.lit("ß"), F.lit("ss"))


def preview(c: Column, n: int = 120) -> Column:
    return F.substring(c, 1, n)
