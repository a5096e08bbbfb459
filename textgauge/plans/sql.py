"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from textgauge.functions import lexicons as lex
from textgauge.functions.text import fold_accents

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
SPACE = r"[\s\v\x{a0}]"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[{LATIN}]+(?:[-''][{LATIN}]+)?|\\d+')"


def normalized_words(x: str) -> str:
    return f"list_transform(list_filter({words(x)}, lambda w: regexp_matches(w, '[{LATIN}]')), lambda w: strip_accents(lower(w)))"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?…]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def feature_words(x: str) -> str:
    c = f"0-9{LATIN}"
    blanked = f"regexp_replace({x}, '[\\p{{L}}\\p{{N}}_]*(?:_|[^{c}\\P{{L}}]|[^{c}\\P{{N}}])[\\p{{L}}\\p{{N}}_]*', ' ', 'g')"
    return f"regexp_extract_all({blanked}, '[{c}]+(?:[-''’][{c}]+)*')"


def feature_sentences(x: str) -> str:
    parts = f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?…]+[.!?…]*'), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"CASE WHEN {strip(x)} = '' THEN [] WHEN len({parts}) > 0 THEN {parts} ELSE [{strip(x)}] END"


def normalize_text(x: str) -> str:
    return strip(f"regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')")


def leakage_form(x: str) -> str:
    return strip(f"regexp_replace(strip_accents(lower({strip(f'coalesce({x}, {q("")})')})), '[^0-9a-záàâãéêíóôõúç]+', ' ', 'g')")


def clean_text(x: str) -> str:
    a = f"regexp_replace(regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    a = f"regexp_replace({a}, '[ \\t\\f\\v]+', ' ', 'g')"
    return strip(f"regexp_replace(regexp_replace({a}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def csv_text(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def share_in(w: str, lexicon) -> str:
    return f"len(list_filter({w}, lambda t: list_contains({strings(lexicon)}, t))) / greatest(len({w}), 1)"


def folded(lexicon) -> list[str]:
    return sorted({fold_accents(x.lower()) for x in lexicon})


def chars(x: str, which: str) -> str:
    return f"(length({x}) - length(translate({x}, {q(which)}, '')))"


def length_bin(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in lex.LENGTH_BINS) + " ELSE 'out_of_range' END"


AUDIT_BIN = "CASE WHEN {n} <= 40 THEN '<=40' WHEN {n} <= 80 THEN '41-80' WHEN {n} <= 120 THEN '81-120' WHEN {n} <= 160 THEN '121-160' WHEN {n} <= 220 THEN '161-220' ELSE '>220' END"


def audit_bin(n: str) -> str:
    return AUDIT_BIN.format(n=n)


def char_ngrams(x: str, n: int = 5) -> str:
    p = f"('  ' || {x} || '  ')"
    return f"CASE WHEN {x} = '' THEN [] WHEN length({p}) <= {n} THEN [{p}] ELSE list_distinct(list_transform(range(1, length({p}) - {n - 2}), lambda i: substr({p}, i, {n}))) END"


def editorial(x: str) -> str:
    return "regexp_matches(strip_accents(lower(" + x + ")), " + q("|".join(lex.EDITORIAL)) + ")"


#: The 12 builder features of column t with tokens w and sentences s.
BUILDER = f"""
len(w)::DOUBLE AS num_palavras, len(s)::DOUBLE AS num_sentencas,
coalesce(list_sum(list_transform(s, lambda y: len(list_filter({words('y')}, lambda v: regexp_matches(v, '[{LATIN}]'))))), 0)::DOUBLE / greatest(len(s), 1) AS media_palavras_por_sentenca,
len(list_distinct(w)) / greatest(len(w), 1) AS type_token_ratio,
len(list_filter(w, lambda v: length(v) >= 8)) / greatest(len(w), 1) AS razao_palavras_longas,
{share_in('w', folded(lex.SUBORDINATION))} AS frequencia_subordinacao,
{share_in('w', folded(lex.DISCOURSE))} AS frequencia_marcadores_discursivos,
{chars('t', ',;:!?—-()')} / greatest(length(t), 1) AS densidade_pontuacao,
{share_in('w', folded(lex.ABSTRACT))} AS frequencia_abstracao,
{share_in('w', folded(lex.AMBIGUITY))} AS frequencia_ambiguidade,
{share_in('w', folded(lex.TEMPORAL))} AS frequencia_temporalidade,
CASE WHEN regexp_matches(t, '(^|{SPACE})[—-]{SPACE}*[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dialogo_detectado"""
SCORE = " + ".join(f"{w!r}::DOUBLE * least({n} / {s!r}::DOUBLE, {c!r}::DOUBLE)" for n, (w, s, c) in lex.SCORE_TERMS.items()) + f" - {lex.DIALOGUE_PENALTY!r}::DOUBLE * dialogo_detectado"


def r6(x: str) -> str:
    return f"round_even({x}, 6)"


def over(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {a} / {b} END"


def linguistic(long_word: int = 7) -> str:
    """The 17 features of stripped column t with lower-case tokens w, sentences s and words of non-empty sentences l."""
    n, k, d = "len(w)", "len(s)", "len(list_distinct(w))"
    hit = lambda lexicon: f"len(list_filter(w, lambda v: list_contains({strings(lexicon)}, v)))"
    nums = "len(regexp_extract_all(regexp_replace(t, '[\\p{L}\\p{N}_]*[\\p{L}_][\\p{L}\\p{N}_]*', ' ', 'g'), '\\d+(?:[.,]\\d+)?'))"
    cols = {
        "num_caracteres": "length(t)",
        "num_palavras": n,
        "num_sentencas": k,
        "media_palavras_por_sentenca": r6(over(n, k)),
        "media_caracteres_por_palavra": r6(over("length(array_to_string(w, ''))", n)),
        "maior_sentenca_palavras": "coalesce(list_max(l), 0)",
        "variancia_tamanho_sentencas": r6("CASE WHEN len(l) < 2 THEN 0.0::DOUBLE ELSE list_var_samp(l) END"),
        "palavras_unicas": d,
        "type_token_ratio": r6(over(d, n)),
        "diversidade_lexical": r6(over(d, n)),
        "razao_palavras_longas": r6(over(f"len(list_filter(w, lambda v: length(v) >= {long_word}))", n)),
        "razao_palavras_repetidas": r6(over(f"({n} - len(list_filter(map_values(list_histogram(w)), lambda c: c = 1)))", n)),
        "razao_pontuacao": r6(over(chars("t", lex.PUNCTUATION), "length(t)")),
        "razao_numeros": r6(over(nums, f"greatest({n}, {nums})")),
        "frequencia_conectivos": r6(over(hit(lex.CONNECTIVES), n)),
        "frequencia_marcadores_subordinacao": r6(over(hit(lex.SUBORDINATION_MARKERS), n)),
        "densidade_lexical_aproximada": r6(over(f"({n} - {hit(lex.FUNCTION_WORDS)})", n)),
    }
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


FEATURE_INPUT = f"""
f0 AS (SELECT *, {strip('coalesce(text, ' + q('') + ')')} AS t FROM documents),
f1 AS (SELECT *, {feature_words('lower(t)')} AS w, {feature_sentences('t')} AS s FROM f0),
f2 AS (SELECT *, list_filter(list_transform(s, lambda y: len({feature_words('y')})), lambda c: c > 0) AS l FROM f1)"""
