"""Word lists, patterns and label names that results depend on.  The two families of lists are independent."""

from __future__ import annotations

# --- corpus builder (fixed values) ---
STOPWORDS = [
    "a", "o", "as", "os", "um", "uma", "uns", "umas", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "por", "para",
    "com", "sem", "que", "se", "e", "ou", "mas", "como", "ao", "aos", "à", "às", "era", "foi", "ser", "ter", "havia", "não", "mais",
    "menos", "muito", "também", "lhe", "seu", "sua", "seus", "suas", "ele", "ela",
]
SUBORDINATION = [
    "porque", "embora", "quando", "enquanto", "conforme", "caso", "se", "como", "pois", "portanto", "todavia", "entretanto", "contudo",
    "ainda", "apesar", "segundo", "logo", "desde", "até", "onde", "cujo", "cuja", "quais", "qual", "quanto", "que",
]
DISCOURSE = [
    "assim", "portanto", "logo", "porém", "contudo", "entretanto", "todavia", "além", "desse", "modo", "por isso", "depois", "antes",
    "durante", "enfim", "então", "finalmente", "também",
]
ABSTRACT = [
    "memória", "lembrança", "tempo", "destino", "consciência", "culpa", "desejo", "moral", "sentido", "interpretação", "linguagem",
    "identidade", "solidão", "angústia", "imaginação", "julgamento", "hipótese", "abstração", "pensamento", "verdade", "aparência",
    "realidade",
]
AMBIGUITY = [
    "ambíguo", "ambígua", "incerto", "incerta", "silêncio", "sugerido", "implícito", "implícita", "metáfora", "símbolo", "simbólico",
    "perspectiva", "enunciação", "fragmento", "lacuna", "ironia", "paradoxo", "contradição", "deslocamento", "reconstruir", "inferência",
]
TEMPORAL = [
    "ontem", "hoje", "amanhã", "passado", "presente", "futuro", "outrora", "agora", "antes", "depois", "tempo", "memória", "lembrança",
    "recordação", "anos", "dias", "noite", "tarde",
]
EDITORIAL = [
    "project gutenberg", "produced by", "online distributed proofreading", "start of the project", "end of the project", "ebook",
    "license", "copyright", "transcriber", "nota de editor", "índice", "indice", "sumario", "sumário", "bibliotheca", "typographia",
    "livreiro-editor",
]
AUDIT_EDITORIAL = [
    "project gutenberg", "produced by", "online distributed proofreading", "license", "ebook", "start of the project",
    "end of the project", "transcriber",
]
BOILERPLATE_START = [r"\*\*\* START OF (?:THE )?PROJECT GUTENBERG EBOOK.*?\*\*\*", r"\*\*\* START OF THIS PROJECT GUTENBERG EBOOK.*?\*\*\*"]
BOILERPLATE_END = [r"\*\*\* END OF (?:THE )?PROJECT GUTENBERG EBOOK.*", r"\*\*\* END OF THIS PROJECT GUTENBERG EBOOK.*"]
LENGTH_BINS = [(80, 120), (121, 160), (161, 220)]
LABELS = ["baixa", "media", "alta"]
#: name of the feature: weight, scale, cap
SCORE_TERMS = {
    "media_palavras_por_sentenca": (0.18, 35.0, 1.5),
    "razao_palavras_longas": (0.12, 0.35, 1.5),
    "type_token_ratio": (0.10, 0.85, 1.3),
    "frequencia_subordinacao": (0.13, 0.12, 1.5),
    "frequencia_marcadores_discursivos": (0.10, 0.08, 1.5),
    "densidade_pontuacao": (0.07, 0.05, 1.5),
    "frequencia_abstracao": (0.14, 0.07, 1.8),
    "frequencia_ambiguidade": (0.08, 0.04, 1.8),
    "frequencia_temporalidade": (0.04, 0.06, 1.5),
}
DIALOGUE_PENALTY = 0.04

# --- linguistic features (fixed values) ---
CONNECTIVES = [
    "ademais", "afinal", "ainda", "assim", "contudo", "entretanto", "logo", "mas", "nem", "ou", "pois", "porém", "portanto", "porque",
    "quando", "também", "todavia", "e",
]
SUBORDINATION_MARKERS = ["caso", "conforme", "conquanto", "embora", "enquanto", "onde", "para", "porque", "quando", "quanto", "que", "se", "segundo"]
FUNCTION_WORDS = [
    "a", "à", "ao", "aos", "as", "às", "com", "da", "das", "de", "do", "dos", "e", "em", "entre", "esse", "essa", "isso", "na", "nas",
    "no", "nos", "o", "os", "ou", "para", "por", "que", "se", "sem", "sob", "sobre", "um", "uma", "uns", "umas",
]
FEATURES = [
    "num_caracteres", "num_palavras", "num_sentencas", "media_palavras_por_sentenca", "media_caracteres_por_palavra",
    "maior_sentenca_palavras", "variancia_tamanho_sentencas", "palavras_unicas", "type_token_ratio", "diversidade_lexical",
    "razao_palavras_longas", "razao_palavras_repetidas", "razao_pontuacao", "razao_numeros", "frequencia_conectivos",
    "frequencia_marcadores_subordinacao", "densidade_lexical_aproximada",
]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’—–…«»"
#: Column names that give the target away, after normalisation.
TARGET_LIKE = [
    "classe", "class", "label", "labels", "target_encoded", "target_code", "nivel", "nível", "complexidade", "complexidade_cognitiva", "categoria",
]
