"""Word lists, lookup tables, thresholds and limits.

These must equal the published archive's values for results to agree, so they
are stated plainly here and used everywhere else by name.  Markers are matched
against accent-folded lower-case text, so only the unaccented spelling is kept.
"""

from __future__ import annotations

# --- geography --------------------------------------------------------------
BR_STATES = {
    "AC": "Acre", "AL": "Alagoas", "AP": "Amapá", "AM": "Amazonas", "BA": "Bahia",
    "CE": "Ceará", "DF": "Distrito Federal", "ES": "Espírito Santo", "GO": "Goiás",
    "MA": "Maranhão", "MT": "Mato Grosso", "MS": "Mato Grosso do Sul",
    "MG": "Minas Gerais", "PA": "Pará", "PB": "Paraíba", "PR": "Paraná",
    "PE": "Pernambuco", "PI": "Piauí", "RJ": "Rio de Janeiro",
    "RN": "Rio Grande do Norte", "RO": "Rondônia", "RR": "Roraima",
    "RS": "Rio Grande do Sul", "SC": "Santa Catarina", "SE": "Sergipe",
    "SP": "São Paulo", "TO": "Tocantins",
}
CL_REGIONS = {
    "XV": "Arica y Parinacota", "I": "Tarapacá", "II": "Antofagasta", "III": "Atacama",
    "IV": "Coquimbo", "V": "Valparaíso", "RM": "Metropolitana", "VI": "O'Higgins",
    "VII": "Maule", "XVI": "Ñuble", "VIII": "Biobío", "IX": "Araucanía",
    "XIV": "Los Ríos", "X": "Los Lagos", "XI": "Aysén", "XII": "Magallanes",
}
COUNTRY_NAMES = {"BR": "Brasil", "CL": "Chile"}

# --- taxonomy ---------------------------------------------------------------
SUBTYPES_BY_FAMILY = {
    "homicidio": [
        "simples", "qualificado", "feminicidio", "latrocinio", "infanticidio",
        "intervencao_policial", "morte_transito_doloso",
    ],
    "tentativa": ["simples", "feminicidio", "latrocinio"],
    "acidente_fatal": ["culposo", "transito_culposo"],
    "nao_classificado": ["outro"],
}
HOMICIDE_SUBTYPES = SUBTYPES_BY_FAMILY["homicidio"]
DEFAULT_SUBTYPE = {
    "homicidio": "simples", "tentativa": "simples",
    "acidente_fatal": "culposo", "nao_classificado": "outro",
}
# family, subtype, Portuguese label, Spanish label
TAXONOMY_LABELS = [
    ("homicidio", "simples", "Homicídio simples", "Homicidio simple"),
    ("homicidio", "qualificado", "Homicídio qualificado", "Homicidio calificado"),
    ("homicidio", "feminicidio", "Feminicídio", "Femicidio"),
    ("homicidio", "latrocinio", "Latrocínio", "Robo con homicidio"),
    ("homicidio", "infanticidio", "Infanticídio", "Infanticidio"),
    ("homicidio", "intervencao_policial", "Intervenção policial", "Intervención policial"),
    ("homicidio", "morte_transito_doloso", "Morte dolosa no trânsito", "Muerte dolosa en tránsito"),
    ("tentativa", "simples", "Tentativa de homicídio", "Tentativa de homicidio"),
    ("tentativa", "feminicidio", "Tentativa de feminicídio", "Tentativa de femicidio"),
    ("tentativa", "latrocinio", "Tentativa de latrocínio", "Tentativa de robo con homicidio"),
    ("acidente_fatal", "culposo", "Homicídio culposo", "Homicidio culposo"),
    ("acidente_fatal", "transito_culposo", "Acidente de trânsito fatal", "Accidente de tránsito fatal"),
    ("nao_classificado", "outro", "Não especificado", "No especificado"),
]
# legacy flat label -> (family, subtype)
LEGACY_LABELS = {
    "Homicídio": ("homicidio", "simples"),
    "Homicídio Qualificado": ("homicidio", "qualificado"),
    "Feminicídio": ("homicidio", "feminicidio"),
    "Latrocínio": ("homicidio", "latrocinio"),
    "Infanticídio": ("homicidio", "infanticidio"),
    "Intervenção policial": ("homicidio", "intervencao_policial"),
    "Morte no trânsito": ("homicidio", "morte_transito_doloso"),
    "Tentativa de Homicídio": ("tentativa", "simples"),
    "Homicídio Culposo": ("acidente_fatal", "culposo"),
    "Outro": ("nao_classificado", "outro"),
}
# words that name the security-force victim type
OFFICER_WORDS = ("policial vitimado", "homicídio de policial", "homicidio de policial")
# other labels by their words: all groups must occur, each by any of its words; first hit wins
LABEL_WORD_RULES = [
    ((("tentativa",), ("feminic",)), ("tentativa", "feminicidio")),
    ((("tentativa",), ("latroc",)), ("tentativa", "latrocinio")),
    ((("tentativa",),), ("tentativa", "simples")),
    ((OFFICER_WORDS,), ("homicidio", "simples")),
    ((("culposo",), ("trânsito", "transito")), ("acidente_fatal", "transito_culposo")),
    ((("culposo",),), ("acidente_fatal", "culposo")),
    ((("acidente",), ("trânsito",)), ("acidente_fatal", "transito_culposo")),
]
UNKNOWN_PAIR = ("nao_classificado", "outro")
# portal label -> subtype, beyond the legacy labels
PORTAL_LABELS = {
    "Homicídio": "simples",
    "Homicídio simples": "simples",
    "Homicídio Qualificado": "qualificado",
    "Homicídio qualificado": "qualificado",
    "Feminicídio": "feminicidio",
    "Latrocínio": "latrocinio",
    "Infanticídio": "infanticidio",
    "Intervenção policial": "intervencao_policial",
    "Morte no trânsito": "morte_transito_doloso",
    "Morte dolosa no trânsito": "morte_transito_doloso",
}
PUBLIC_FAMILY = "homicidio"
PUBLIC_CLASS = "incident"
PUBLIC_MAX_VICTIMS = 10
SLAIN_OFFICER_KEY = "security_force_victim"
METHOD_UNSPECIFIED = "Não especificado"
TYPE_UNCLASSIFIED = "Não classificado"
PERIOD_ORDER = ["madrugada", "manhã", "manha", "tarde", "noite"]

# --- public export ----------------------------------------------------------
EXPORT_COLUMNS = [
    "id", "event_family", "event_subtype", "homicide_type", "method_of_death",
    "event_date", "time_of_day", "country", "state", "city", "neighborhood", "street",
    "latitude", "longitude", "location_precision", "victim_count", "perpetrator_count",
    "security_force_involved", "security_force_victim", "criminal_group_connected",
    "criminal_group_activity", "criminal_group_activity_description", "criminal_groups",
    "criminal_group_attacked", "police_operation_connected", "police_operation_force",
    "police_operation_targeted_armed_groups", "off_duty_police_perpetrator",
    "off_duty_police_context", "politician_or_candidate_victim", "victim_political_status",
    "victim_political_office", "victim_political_party", "title",
    "chronological_description", "source_count", "created_at", "updated_at",
]
EXPORT_MAX_ROWS = 50_000
MAP_WINDOW_DAYS = 365

# --- lifecycle --------------------------------------------------------------
SOURCE_STATUSES = [
    "ready_for_classification", "classifying", "discarded", "ready_for_download",
    "downloading", "failed_in_download", "ready_for_extraction", "extracting",
    "failed_in_extraction", "extracted",
]
HOURLY_STATUSES = [
    "ready_for_classification", "classifying", "discarded", "ready_for_download",
    "failed_in_download", "ready_for_extraction", "failed_in_extraction", "extracted",
]
# transient status -> queue it returns to
STUCK_RETURNS = {
    "classifying": "ready_for_classification",
    "downloading": "ready_for_download",
    "extracting": "ready_for_extraction",
}
POSITIVE_STATUSES = [
    "ready_for_download", "downloading", "ready_for_extraction", "extracting", "extracted",
]
STUCK_MINUTES = 15
RETRY_MAX_ATTEMPTS = 3
TRANSIENT_REASONS = [
    "fetch_timeout", "fetch_server_error", "fetch_network_error", "fetch_blocked",
    "llm_rate_limit", "llm_quota", "llm_timeout",
]
FILTER_REASONS = [
    "aggregate_content", "foreign_content", "non_incident_content", "llm_content_reject",
]

# --- matching thresholds ----------------------------------------------------
NAME_RATIO = 0.85
TITLE_RATIO = 0.80
TITLE_SOFT_RATIO = 0.72
DESCRIPTION_RATIO = 0.55
CONTEXT_RATIO = 0.28
PENDING_TITLE_RATIO = 0.70
MATCH_CONFIDENCE = 0.6
DATE_CITY_DAYS = 1
NAME_DAYS = 10
NAME_UNDATED_DAYS = 30
TITLE_DAYS = 3

# --- headline rules ---------------------------------------------------------
EXPLICIT_DEATH = [
    "nao resistiu", "nao resiste", "morre no hospital", "morre apos", "veio a obito",
    "faleceu", "falece", "obito", "encontrado morto", "achado morto",
]
SURVIVAL_PATTERN = (
    r"\bsobrevive\b|\bsobreviveu\b|\bsobreviveram\b|quadro estavel|\bhospital\b"
    r"|centro cirurgico|\binternad|\bsocorrid|\bferid[oa]s?\b|chora ao ver"
    r"|banco dos reus|\bsao presos\b|\bforam presos\b"
)
FOREIGN_MARKERS = [
    " texas", " eua", " nos eua", "estados unidos", " russia", " ucrania",
    " venezuela", " mexico", " base militar russa",
]
METAPHOR_MARKERS = [
    "assassinato da lingua", "executa o orcamento", "ultimo capitulo da novela", "virou piada",
]
ACCIDENT_MARKERS = [
    "morte instantanea", "cair do", "falta de epi", "perdeu a vida preso",
    "perde a vida preso", "perde freio", "infarto fulminante",
]
POLICE_MARKERS = ["cumpre mandados", "apreende arsenal", "seria usado para cometer"]
SHOOTOUT_PATTERN = r"troca tiros"
DEATH_HINT_PATTERN = (
    r"neutraliz|morto|morta|mortos|mortas|tomb|cpf cancel|deixa sobreviventes|chacina"
)
IMPLIED_FATAL = [
    "crivado de balas", "crivada de balas", "restos mortais", "carbonizado no porta-malas",
    "carbonizado no portamalas", "achado carbonizado", "neutralizado", "tombaram", "tombou",
    "cpf cancelado", "cpfs cancelados", "nao deixa sobreviventes",
    "linchado ate parar de respirar", "ossada humana", "marca de tiro no cranio",
    "corpo amarrado", "execucao brutal", "nao resistiu aos ferimentos", "nao resiste",
    "feminicidio", "homicidio doloso", "duplo homicidio", "chacina",
]
NOTE_FORCED_NEGATIVE = "[heuristic: survival/foreign/metaphor/accident/non-death police op]"
NOTE_FORCED_POSITIVE = "[heuristic: implied fatal violence in headline]"
DEATH_KEYWORDS = (
    r"(?iU)\b(morto|morta|mortos|mortas|assassin|homicíd|homicid|executad|corpo|feminicíd"
    r"|feminicid|latrocín|latrocin|assassinat|crivad|neutralizad|chacina|carbonizad"
    r"|linchad|tombou|tombaram)\b"
)
EVAL_DEATH_KEYWORDS = (
    r"(?iU)\b(morto|morta|mortos|mortas|assassin|homicíd|homicid|executad|corpo|feminicíd"
    r"|feminicid|latrocín|latrocin|assassinat)\b"
)
HEADLINE_TAGS = [
    ("injured_not_dead", ["ferid", "balead", "sobreviv"]),
    ("death_keyword", None),
    ("ambiguous", ["operação", "operacao", "confronto", "tiroteio"]),
    ("clear_false", ["prende", "apreend", "política", "politica"]),
    ("clear_true", ["morto", "morta", "assassin", "corpo"]),
]

# --- article rules: (class, rule, pattern), first match wins -----------------
ARTICLE_RULES = [
    ("aggregate_statistics", "cvli_year_report",
     r"\bcvli\b.*\b(20\d{2}|regist(?:ou|ra)|mortes?\s+violentas?)\b"),
    ("aggregate_statistics", "annual_balance",
     r"\bbalan[çc]o\s+(anual|de\s+mortes|crim(?:inal|inalidade))\b"),
    ("aggregate_statistics", "large_victim_total",
     r"\b(\d{1,3}[.,]\d{3}|\d{4,})\s+(mortes?\s+violentas?|v[ií]timas?)\b"),
    ("aggregate_statistics", "year_state_total",
     r"\b(mortes?\s+violentas?|v[ií]timas?).{0,40}\b(20\d{2}|no\s+estado|em\s+todo\s+o\s+estado)\b"),
    ("aggregate_statistics", "national_study",
     r"\b(estudo|pesquisa|mapa|painel).{0,60}\b(mortes?\s+violentas?|homic[ií]dios?)\b"
     r".{0,40}\b(brasil|pa[ií]s|nacional)\b"),
    ("aggregate_statistics", "monthly_roundup",
     r"\bno\s+m[eê]s.{0,40}\b(regist(?:ou|ra)|foram)\s+\d+\s+(mortes?|homic[ií]dios?)\b"),
    ("foreign", "foreign_earthquake",
     r"\bterremoto.{0,80}\b(venezuela|chile|turquia|turkey|m[eé]xico|haiti|afeganist[aã]o)\b"),
    ("foreign", "foreign_country_disaster",
     r"\b(desastre|terremoto|tsunami|guerra).{0,40}\b(venezuela|ucr[aâ]nia|gaza|s[ií]ria|sud[aã]o)\b"),
    ("foreign", "foreign_mass_shooting",
     r"\b(atirador|tiroteio|mass\s+shooting).{0,40}"
     r"\b(eua|estados\s+unidos|texas|california|paris|londres)\b"),
    ("non_incident", "suicide",
     r"\b(suic[ií]dio|tirou\s+a\s+pr[oó]pria\s+vida|enforcou-se|se\s+matou)\b"),
    ("non_incident", "animal_cruelty",
     r"\b(cachorro|gato|animal|cavalo).{0,40}\b(morto|mortos|envenenado|maltratado)\b"),
]
CLASS_REASON = {"aggregate_statistics": "aggregate_content", "foreign": "foreign_content"}
CLASS_REASON_DEFAULT = "non_incident_content"

# --- extraction corrections ---------------------------------------------------
METHOD_RULES = [
    ("Arma de fogo", [
        "disparo", "tiros", "tiro ", "baleado", "baleada", "baleados", "execute", "executado",
        "executada", "queima-roupa", "queima roupa", "revolver", "pistola", "fuzil", "calibre",
        "marcas de tiros",
    ]),
    ("Arma branca", ["facada", "facadas", "faca", "punhal", "facao", "golpes de faca"]),
    ("Estrangulamento", ["estrangul", "enforcad", "enforcam", "asfixi"]),
    ("Atropelamento", ["atropel"]),
    ("Envenenamento", ["envenen", "intoxic"]),
    ("Espancamento", ["espanc", "socos", "pauladas", "sinais de espancamento"]),
    ("Objeto contundente", [
        "objeto contundente", "contundente", "traumatismo craniano",
        "ferimento profundo na cabeca",
    ]),
]
GUN_EVIDENCE = ["marca de tiro", "marcas de tiro", "disparo", "balead", " tiro", "tiros"]
UNSPECIFIED_METHOD = [
    "nao conseguiu determinar", "nao foi possivel determinar", "objeto usado no crime",
    "metodo nao", "causa nao divulgada", "causa da morte nao", "sem informacoes sobre",
]
CAUSE_WORDS = ["causa", "metodo", "hipotese"]
QUALIFIED_MARKERS = [
    "queima-roupa", "queima roupa", "dezenas de tiros", "multiplos disparos a queima-roupa",
    "multiplos disparos a queima roupa", "chacina", "maos e os pes amarrados",
    "maos e pes amarrados", "pes amarrados", "tortura", "emboscada",
]
HYPOTHESIS_MARKERS = ["hipotese", "linha de investigacao", "principal hipotese"]
ELSEWHERE_MARKERS = ["executado em outro local", "morto em outro local"]
POLICE_WORDS = ["policia", "pm ", "rota", "policiais militares"]
PATROL_MARKERS = [
    "recebidas a tiros", "reagiu atirando", "grupo de criminosos", "confronto entre policiais",
    "troca de tiros com", "patrulhamento", "abordagem", "abordar um veiculo",
]
SCANT_MARKERS = [
    "nao ha detalhes sobre a identidade", "nenhuma outra informacao foi divulgada",
]
VIOLENT_WORDS = [
    "assassin", "homicidio", "executad", "balead", " tiros", "disparo", "facad", "espanc",
]
CAMPO_GRANDE_HINTS = ["campo grande news", "campograndenews"]
WEEKDAYS = {
    "segunda": 0, "terca": 1, "quarta": 2, "quinta": 3, "sexta": 4, "sabado": 5, "domingo": 6,
}
COUNT_WORDS = {
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5,
    "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10,
}

# --- language markers -----------------------------------------------------------
SPANISH_MARKERS = [
    " fue ", " fueron ", " está ", " están ", " había ", " habían ", "asesinato", "femicidio",
    "carabineros", "pdi", " región ", " viernes ", " sábado ", " último ", "policía", " ayer ",
]
PORTUGUESE_MARKERS = [
    " foi ", " foram ", " está ", " estão ", " havia ", " estavam ", "assassinato",
    "feminicídio", " polícia ", " última ", " ontem ", " sexta-feira ", " sábado ", "militar",
    " bairro ",
]
CHILE_HINTS = [".cl", "chile", "santiago"]
CHILE_BONUS = 3

# --- victim names ----------------------------------------------------------------
NAME_STOPWORDS = [
    "uma", "um", "o", "a", "os", "as", "de", "da", "do", "das", "dos", "e", "em", "no", "na",
    "nos", "nas", "por", "com", "foi", "vitima", "vitimas", "homem", "mulher", "jovem",
    "pessoa", "pessoas", "trans", "anos", "ano", "nao", "identificado", "identificada",
    "identificados", "identificadas", "desconhecido", "desconhecida", "suspeito", "suspeitos",
    "policial", "policiais", "dois", "duas", "tres", "morto", "morta", "assassinada",
    "assassinado", "encontrado", "encontrada",
]
CONTEXT_CUES = [
    r"\b\d{2,}\s*(?:facadas|golpes|tiros|disparos|perfura[cç][oõ]es)\b",
    r"\b(?:kitnet|quadra\s+\d+|arno\s*\d+|305\s*norte)\b",
    r"\b(?:operacao\s+jovem\s+guerreiro|batalhao\s+de\s+choque)\b",
    r"\b(?:hospital\s+clinica\s+sul|avenida\s+cassiano\s+ricardo)\b",
    r"\b(?:mais\s+de\s+30\s+tiros|mais\s+de\s+30\s+disparos)\b",
    r"\b(?:esposa\s+e\s+(?:o\s+)?filho|esposa\s+e\s+filho)\b",
    r"\b(?:cinco\s+(?:suspeitos|individuos|homens)\s+(?:armados|mascarados))\b",
    r"\b(?:tentou\s+incendiar|tentativa\s+de\s+(?:inc[eê]ndio|queima))\b",
]

# --- geocoding ---------------------------------------------------------------------
PLUS_ALPHABET = "23456789CFGHJMPQRVWX"
PRECISION_ORDER = ["exato", "aproximado", "centro do bairro", "centro da cidade"]
LOCATION_CONFIDENCE = {
    "ROOFTOP": 0.95, "RANGE_INTERPOLATED": 0.75, "GEOMETRIC_CENTER": 0.55, "APPROXIMATE": 0.4,
}
GEOCODE_COLUMNS = [
    "latitude", "longitude", "plus_code", "place_id", "formatted_address",
    "location_precision", "geocoding_source", "geocoding_confidence",
]

# --- metrics -------------------------------------------------------------------------
DURATION_BUCKETS = [0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0]
SIZE_BUCKETS = [512, 2048, 8192, 32768, 131072, 524288, 2097152]
# metric, comparison threshold, severity, rule
ALERT_RULES = [
    ("stuck_sources", 5.0, "critical", "StuckSourcesCritical"),
    ("stuck_sources", 1.0, "warning", "StuckSourcesWarning"),
    ("ready_for_classification", 500.0, "warning", "ClassificationBacklogWarning"),
    ("minutes_since_success", 120.0, "critical", "CronIngestStale"),
    ("minutes_since_success", 90.0, "warning", "CronIngestWarning"),
]
REQUEST_LIMITS = {"geocode": (30, "1 minute"), "export": (5, "1 hour")}

# --- feeds ----------------------------------------------------------------------------
FEED_BASE_URL = "https://news.google.com/rss/search"
FEED_PARAMS = {"BR": "&hl=pt-BR&gl=BR&ceid=BR:pt-419", "CL": "&hl=es-CL&gl=CL&ceid=CL:es-419"}
FEED_WINDOW = "1h"
SHARDING_THRESHOLD = 100
BR_PUBLISHERS = [
    "g1.globo.com", "uol.com.br", "folha.uol.com.br", "estadao.com.br", "oglobo.globo.com",
    "r7.com", "terra.com.br", "metropoles.com", "cnn.com.br", "band.uol.com.br",
    "jovempan.com.br", "correiobraziliense.com.br", "gazetadopovo.com.br", "odia.ig.com.br",
    "diariodepernambuco.com.br", "otempo.com.br", "gazetaonline.com.br", "acritica.com",
    "diariodoaco.com.br",
]
CL_PUBLISHERS = [
    "emol.com", "latercera.com", "elmostrador.cl", "biobiochile.cl", "24horas.cl",
    "meganoticias.cl", "t13.cl", "chvnoticias.cl", "cnnchile.com", "df.cl", "cooperativa.cl",
    "adnradio.cl", "australvaldivia.cl", "elsur.cl", "australtemuco.cl", "mercuriovalpo.cl",
    "soychile.cl", "elllanquihue.cl",
]

# --- review excerpts --------------------------------------------------------------------
GENERIC_WORDS = [
    "homicidio", "homicídio", "feminicidio", "feminicídio", "qualificado", "residencia",
    "residência", "publica", "pública",
]
