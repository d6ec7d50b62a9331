"""Fixed values.

Everything in this module is a fixed value: identifiers, patterns, word lists, weights, limits
and message formats that results depend on. Rules that use them live elsewhere.
"""

# --- anchors: type -> pattern, in extraction order (fixed values) ---
ANCHOR_PATTERNS = {
    "CNPJ": r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b",
    "CPF": r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    "CNJ": r"\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b",
    "SEI": r"\b\d{5}\.\d{6}/\d{4}-\d{2}\b",
    "TCU": r"Acórdão\s+(\d+/\d+)",
    "PL": r"(?:PL|PEC|PLP)\s+\d+(?:/\d+)?",
    "ATO": r"(?:Portaria|Decreto|Resolução)\s+(?:nº\s+)?\d+/\d+",
    "VALOR": r"R\$\s*[\d.]+(?:,\d{2})?",
}

# Characters that every match of a type must contain; a text without them cannot match.
ANCHOR_REQUIRED_CHARS = {
    "CNPJ": ("/", "-"),
    "CPF": (".", "-"),
    "CNJ": (".", "-"),
    "SEI": ("/", "-"),
    "TCU": ("/",),
    "ATO": ("/",),
    "VALOR": ("$",),
}

# Anchor types named by the data model without a pattern; the patterns are ours.
EXTRA_ANCHOR_PATTERNS = {
    "DATA": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "LINK_GOV": r"https?://[^\s]*\.gov[^\s]*",
    "PDF": r"\S+\.pdf\b",
}

ANCHOR_WEIGHTS = {
    "CNPJ": 1.0,
    "CNJ": 1.5,
    "SEI": 1.0,
    "TCU": 2.0,
    "PL": 1.0,
    "ATO": 0.5,
    "VALOR": 0.2,
}
OTHER_ANCHOR_WEIGHT = 0.1
EVIDENCE_SCORE_CAP = 10.0
EVIDENCE_CONTEXT_CHARS = 20

# --- ingest (fixed values) ---
DEFAULT_TITLE_PREFIX = "Sugestão de Pauta: "
DEFAULT_SUMMARY_PREFIX = "Novo sinal de pauta em "
NO_SUMMARY = "Sem resumo"

POOLS = ("FAST_POOL", "HEAVY_RENDER_POOL", "DEEP_EXTRACT_POOL")
STRATEGIES = ("RSS", "HTML", "API", "SPA_API", "SPA_HEADLESS", "PDF")
POOL_QUEUES = {"HEAVY_RENDER_POOL": "fetch_render", "DEEP_EXTRACT_POOL": "fetch_deep"}
DEFAULT_QUEUE = "fetch_fast"

PROFILE_DEFAULTS = {
    "is_official": False,
    "lang": "pt-BR",
    "rate_limit_req_per_min": 10,
    "concurrency_per_domain": 1,
    "timeout_seconds": 30,
    "max_bytes": 5_000_000,
    "starvation_window_hours": 24,
    "baseline_rolling": True,
}
PROFILE_MINIMUMS = {
    "rate_limit_req_per_min": 1,
    "concurrency_per_domain": 1,
    "timeout_seconds": 1,
    "max_bytes": 1024,
    "starvation_window_hours": 1,
}

# --- events and states (fixed values) ---
TIER1_EVENT = ("HOT", 85.0)
OTHER_EVENT = ("NEW", 50.0)
FAST_TIMEOUT_S = 60
RENDER_TIMEOUT_S = 120
DEEP_TARGET_S = 300
QUARANTINE_TTL_S = 900
ALERT_COOLDOWN_S = 300
ALERT_SCORE_THRESHOLD = 70.0
VELOCITY_WINDOW_MINUTES = 30
QUARANTINE_SCORE_BELOW = 20.0
QUARANTINE_MIN_SOURCES = 2
VIRAL_VELOCITY_ABOVE = 50.0
VIRAL_MIN_DIVERSITY = 3
FEEDBACK_ACTIONS = ("IGNORE", "SNOOZE", "PAUTAR", "MERGE", "SPLIT")
ANONYMOUS_ACTOR = "anonymous"
DRAFT_REVIEW_BELOW = 0.7
DRAFT_REVIEW_REASON = "Low confidence in automated extraction"

# --- reason codes, in output order (fixed values) ---
BREAKING_REASONS = (
    "PLANTAO_VELOCITY_SPIKE",
    "PLANTAO_TIER_WEIGHT",
    "PLANTAO_DIVERSITY",
    "PLANTAO_DECAY",
)
GAP_REASONS = (
    "OCEANO_EVIDENCE_STRONG",
    "OCEANO_COVERAGE_LAG",
    "OCEANO_OFFICIAL_SOURCE",
)

# --- source taxonomy: host suffixes and name tokens (fixed values) ---
MEDIA_GROUP_HOST_SUFFIXES = {
    "google_news": ("news.google.com",),
    "uol": ("uol.com.br", "operamundi.uol.com.br"),
    "globo": ("globo.com",),
    "folha": ("folha.uol.com.br", "redir.folha.com.br"),
    "estadao": ("estadao.com.br",),
    "cnn_brasil": ("cnnbrasil.com.br",),
    "metropoles": ("metropoles.com",),
    "r7": ("r7.com",),
    "terra": ("terra.com.br",),
    "jp": ("jp.com.br",),
    "infomoney": ("infomoney.com.br",),
    "exame": ("exame.com",),
    "forum": ("revistaforum.com.br",),
    "brasil_de_fato": ("brasildefato.com.br",),
    "intercept": ("intercept.com.br",),
    "apublica": ("apublica.org",),
    "nexo": ("nexojornal.com.br",),
    "nodal": ("nodal.am",),
}
MAINSTREAM_MEDIA_GROUPS = (
    "google_news",
    "uol",
    "globo",
    "folha",
    "estadao",
    "cnn_brasil",
    "metropoles",
    "r7",
    "terra",
    "jp",
    "infomoney",
    "exame",
)
SOURCE_CLASSES = ("primary", "competitor", "independent", "specialized")

# class -> host suffixes, in the order they are tried
CLASS_HOST_SUFFIXES = {
    "primary": (
        "gov.br",
        "senado.leg.br",
        "camara.leg.br",
        "stf.jus.br",
        "stj.jus.br",
        "tse.jus.br",
        "mpf.mp.br",
        "agenciabrasil.ebc.com.br",
        "ibge.gov.br",
        "fiocruz.br",
    ),
    "specialized": ("jota.info", "conjur.com.br"),
    "competitor": (
        "news.google.com",
        "g1.globo.com",
        "globo.com",
        "uol.com.br",
        "folha.uol.com.br",
        "redir.folha.com.br",
        "estadao.com.br",
        "cnnbrasil.com.br",
        "metropoles.com",
        "infomoney.com.br",
        "exame.com",
        "terra.com.br",
        "r7.com",
        "operamundi.uol.com.br",
    ),
    "independent": (
        "revistaforum.com.br",
        "brasildefato.com.br",
        "tvtnews.com.br",
        "diariodocentrodomundo.com.br",
        "cartacapital.com.br",
        "apublica.org",
        "intercept.com.br",
        "nexojornal.com.br",
        "poder360.com.br",
        "nodal.am",
    ),
}

# class -> name tokens, in the order they are tried
CLASS_NAME_TOKENS = {
    "specialized": ("poder360", "jota", "conjur"),
    "competitor": (
        "uol",
        "folha",
        "globo",
        "g1",
        "estadao",
        "cnn brasil",
        "metropoles",
        "opera mundi",
        "r7",
        "terra",
    ),
    "independent": (
        "revista forum",
        "brasil de fato",
        "intercept",
        "apublica",
        "nexo",
        "nodal",
    ),
    "primary": ("tribunal", "ministerio", "camara", "senado", "prefeitura", "governo"),
}
OTHER_SOURCE_CLASS = "other"

# --- editorial lanes: keywords and priorities (fixed values) ---
LANE_KEYWORDS = {
    "justica": ("stf", "stj", "tse", "justica", "tribunal", "mpf", "ministerio publico", "operacao"),
    "politica": ("politica", "congresso", "senado", "camara", "planalto", "presidente", "eleicao"),
    "economia": ("economia", "mercado", "bolsa", "selic", "copom", "inflacao", "fiscal", "orcamento"),
    "seguranca": ("seguranca", "policia", "crime", "faccao", "prisao", "violencia"),
    "saude": ("saude", "sus", "hospital", "anvisa", "vacin", "epidemia"),
    "educacao": ("educacao", "mec", "enem", "fies", "sisu", "universidade", "escola", "professor", "aluno"),
    "internacional": ("itamaraty", "onu", "mercosul", "internacional", "g20", "g7"),
    "meio_ambiente": (
        "meio ambiente",
        "clima",
        "amazonia",
        "desmatamento",
        "queimada",
        "ibama",
        "icmbio",
        "cop30",
    ),
    "direitos_humanos": (
        "direitos humanos",
        "racismo",
        "violencia policial",
        "feminicidio",
        "indigena",
        "quilombola",
    ),
    "tecnologia": ("tecnologia", "ia", "inteligencia artificial", "chip", "software"),
    "infraestrutura": (
        "rodovia",
        "ferrovia",
        "porto",
        "aeroporto",
        "saneamento",
        "obras",
        "mobilidade urbana",
        "energia",
    ),
    "agronegocio": ("agronegocio", "agro", "safra", "conab", "soja", "milho", "pecuaria", "carne"),
    "esportes": (
        "futebol",
        "campeonato",
        "rodada",
        "gol",
        "time",
        "partida",
        "olimpiada",
        "olimpíada",
        "copa",
    ),
    "entretenimento": (
        "bbb",
        "reality",
        "famoso",
        "celebridade",
        "novela",
        "streaming",
        "serie",
        "série",
        "show",
    ),
    "cultura": ("cultura", "filme", "teatro", "musica", "literatura"),
    "opiniao": ("opiniao", "editorial", "coluna", "artigo"),
}
LANE_PRIORITIES = {
    "justica": 4,
    "politica": 3,
    "economia": 3,
    "seguranca": 3,
    "saude": 2,
    "educacao": 2,
    "internacional": 2,
    "meio_ambiente": 2,
}
OTHER_LANE_PRIORITY = 1
EXTRA_KNOWN_LANES = ("hardnews",)
POLITICS_SCOPES = ("federal", "estadual", "municipal")
WORLD_SCOPE = "internacional"
DEFAULT_LANE = "geral"

# --- seed sources (fixed values) ---
# domain, name, official, source_id, source_domain, pool, strategy, endpoint, endpoint url, cron, seconds, req/min
SEED_SOURCES = (
    ("g1.globo.com", "G1 - Política", False, "g1_politica", "g1.globo.com", "FAST_POOL", "RSS",
     "feed", "https://g1.globo.com/rss/g1/politica/", None, 60, 10),
    ("agenciabrasil.ebc.com.br", "Agência Brasil - Política", True, "agencia_brasil_politica",
     "agenciabrasil.ebc.com.br", "FAST_POOL", "RSS",
     "feed", "https://agenciabrasil.ebc.com.br/rss/politica/feed.xml", None, 300, 10),
    ("www12.senado.leg.br", "Senado - Notícias", True, "senado_noticias", "senado.leg.br", "FAST_POOL", "RSS",
     "feed", "https://www12.senado.leg.br/noticias/rss", None, 600, 5),
    ("www.camara.leg.br", "Câmara - Notícias", True, "camara_noticias", "camara.leg.br", "FAST_POOL", "HTML",
     "latest", "https://www.camara.leg.br/noticias/", None, 1800, 5),
    ("www.poder360.com.br", "Poder360", False, "poder360", "poder360.com.br", "FAST_POOL", "RSS",
     "feed", "https://www.poder360.com.br/feed/", None, 300, 5),
    ("www.jota.info", "JOTA - Notícias", False, "jota_noticias", "jota.info", "FAST_POOL", "RSS",
     "feed", "https://www.jota.info/feed", None, 600, 5),
    ("in.gov.br", "Diário Oficial da União", True, "dou_oficial", "in.gov.br", "DEEP_EXTRACT_POOL", "HTML",
     "latest", "https://www.in.gov.br/leitura-digital", "0 * * * *", None, 5),
    ("tcu.gov.br", "TCU - Notícias", True, "tcu_noticias", "tcu.gov.br", "FAST_POOL", "HTML",
     "latest", "https://portal.tcu.gov.br/imprensa/noticias/", None, 3600, 2),
)
SEED_TIER = 1
