"""Stand-in archive tables derived from the driver's test tables.

The test data are generic (orders, lineitem, events, documents ...), so each
archive table is a deterministic projection of them.  Column expressions are
plain portable SQL, used for both the Spark view and the checking SQL.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import fixed

ORDERS_AS_OF = dt.datetime(2001, 8, 1)
EVENTS_AS_OF = dt.datetime(2024, 1, 31)


def pick(key: str, values: list[str | None]) -> str:
    """CASE expression choosing by key modulo the number of values."""
    arms = " ".join(
        f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values) if v is not None
    )
    return f"CASE ({key}) % {len(values)} {arms} END"


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def by_value(column: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in mapping.items())
    return f"CASE {column} {arms} END"


FIRST_NAMES = ["João", "Maria", "José", "Ana", "Pedro", "Carla", "Luís", "Rita", "Paulo", "Inês", "Tiago"]
LAST_NAMES = ["Silva", "Souza", "Conceição", "Lima", "Araújo", "Rocha", "Mendes", "Galvão", "Prado"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
REASONS = [
    "fetch_timeout", "fetch_blocked", "empty_content", "llm_rate_limit", "validation_error",
    "aggregate_content", "llm_unknown",
]
STATES20 = list(fixed.BR_STATES)[:20]
REGIONS5 = list(fixed.CL_REGIONS.values())[:5]


def full_name(a: str, b: str) -> str:
    return f"{pick(a, FIRST_NAMES)} || ' ' || {pick(b, LAST_NAMES)}"


INCIDENT = {
    "id": "o_orderkey",
    "event_family": pick("o_orderkey", ["homicidio"] * 7 + ["tentativa", "acidente_fatal", None]),
    "event_subtype": by_value("o_orderpriority", dict(zip(
        PRIORITIES, ["qualificado", "feminicidio", "simples", "latrocinio", "intervencao_policial"]))),
    "homicide_type": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE " + by_value("o_orderpriority", dict(zip(
        PRIORITIES, ["Homicídio Qualificado", "Feminicídio", "Homicídio", "Latrocínio", "Intervenção policial"]))) + " END",
    "method_of_death": pick("o_orderkey", [
        "Arma de fogo", "Arma branca", "Estrangulamento", "Atropelamento", "Espancamento", None, "Arma de fogo"]),
    "content_class": "CASE WHEN o_orderkey % 19 = 0 THEN 'non_incident' WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'incident' END",
    "event_date": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END",
    "time_of_day": pick("o_orderkey", ["madrugada", "manhã", "manha", "tarde", "noite", None]),
    "country": "CASE WHEN c_nationkey >= 20 THEN 'Chile' WHEN o_orderkey % 2 = 0 THEN 'Brasil' ELSE 'BR' END",
    "state": "CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN c_nationkey < 20 THEN "
             + pick("c_nationkey", STATES20) + " ELSE " + pick("c_nationkey", REGIONS5) + " END",
    "city": "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR(9)) END",
    "neighborhood": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Bairro ' || CAST(o_custkey % 7 AS VARCHAR(9)) END",
    "latitude": "CASE WHEN o_custkey % 31 = 0 THEN NULL ELSE CAST((o_custkey * 7) % 3000 AS DOUBLE) / 100 - 33 END",
    "longitude": "CASE WHEN o_custkey % 31 = 0 THEN NULL ELSE CAST((o_custkey * 13) % 3500 AS DOUBLE) / 100 - 73 END",
    "victim_count": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 13 AS INT) END",
    "perpetrator_count": "CAST(o_orderkey % 3 AS INT)",
    "security_force_involved": "CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "security_force_victim": "CASE o_orderkey % 8 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END",
    "confirmed": "o_orderstatus = 'F'",
    "source_count": "CAST(1 + o_orderkey % 4 AS INT)",
    "needs_enrichment": "o_orderkey % 9 = 0",
    "title": "'Caso ' || lower(o_orderpriority) || ' em ' || c_mktsegment",
    "chronological_description": "'Registro ' || o_orderstatus || ' no valor de ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(19)) || ' em ' || c_mktsegment",
    "victims_summary": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE " + full_name("o_custkey", "o_custkey")
                       + " || ', ' || CAST(18 + o_custkey % 60 AS VARCHAR(9)) || ' anos' END",
    "created_at": "o_orderdate",
    "updated_at": "o_orderdate",
}

RAW = {
    "id": "raw_id",
    "unique_event_id": "CASE WHEN (l_orderkey * 8 + l_linenumber) % 3 = 0 THEN NULL ELSE l_orderkey END",
    "source_google_news_id": "CASE WHEN (l_orderkey * 8 + l_linenumber) % 5 = 0 THEN NULL ELSE l_partkey END",
    "event_date": "CASE WHEN l_partkey % 43 = 0 THEN NULL ELSE l_shipdate END",
    "city": pick("l_partkey", SEGMENTS) + " || ' ' || CAST(s_nationkey AS VARCHAR(9))",
    "state": "CASE WHEN s_nationkey < 20 THEN " + pick("s_nationkey", STATES20) + " ELSE " + pick("s_nationkey", REGIONS5) + " END",
    "neighborhood": "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 'Bairro ' || CAST(l_suppkey % 7 AS VARCHAR(9)) END",
    "event_family": "CASE WHEN l_partkey % 2 = 0 THEN 'homicidio' END",
    "event_subtype": "CASE WHEN l_partkey % 2 = 0 THEN 'simples' END",
    "homicide_type": pick("l_partkey", list(fixed.LEGACY_LABELS) + [None, "Tentativa de feminicídio"]),
    "method_of_death": pick("l_partkey", ["Arma de fogo", "Arma branca", None]),
    "content_class": "CASE WHEN l_partkey % 20 = 0 THEN 'non_incident' ELSE 'incident' END",
    "victim_count": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(1 + l_partkey % 4 AS INT) END",
    "security_force_involved": "CASE l_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "title": "'Caso ' || lower(" + pick("l_suppkey", PRIORITIES) + ") || ' em ' || " + pick("l_partkey", SEGMENTS),
    "chronological_description": "'Registro ' || l_returnflag || ' com ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(19)) || ' itens'",
    "name": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE " + full_name("l_partkey", "l_suppkey") + " END",
    "deduplication_status": "CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'matched' END",
    "extraction_success": "CASE l_returnflag WHEN 'R' THEN FALSE WHEN 'A' THEN NULL ELSE TRUE END",
    "is_gold_standard": "l_linenumber = 1",
    "created_at": "l_shipdate",
}
# one record per line; order and line number repeat in the generated table, so
# the id is the head of a hash over the columns that tell rows apart, which is
# the one expression the two engines spell differently
_RAW_TEXT = "md5(concat_ws('|', " + ", ".join(
    f"CAST(CAST({c} AS BIGINT) AS VARCHAR(19))" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) + "))"
RAW_ID_SPARK = f"CAST(conv(substr({_RAW_TEXT}, 1, 15), 16, 10) AS BIGINT)"
RAW_ID_SQL = f"CAST('0x' || substr({_RAW_TEXT}, 1, 15) AS BIGINT)"

SOURCE = {
    "id": "event_id",
    "google_news_id": "'g' || CAST(event_id % 5000 AS VARCHAR(19))",
    "resolved_url": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'https://www.jornal' || CAST(user_id % 23 AS VARCHAR(9)) || '.example.com/n/' || CAST(event_id % 3000 AS VARCHAR(19)) END",
    "headline": "CASE WHEN event_id % 25 = 0 THEN NULL ELSE " + pick("event_id", [
        "Homem é morto a tiros", "Jovem ferido segue no hospital", "Corpo amarrado é achado em mata",
        "Prefeito executa o orçamento", "Polícia cumpre mandados na capital", "Mulher é vítima de feminicídio",
        "PM troca tiros com grupo", "Homem não resistiu e faleceu no hospital", "Chacina deixa mortos", "Assassin em fuga",
        "Tiroteio nos EUA", "Suspeito é preso com drogas", "Bandidos tombaram em confronto"]) + " || ' ' || CAST(user_id AS VARCHAR(9)) END",
    "publisher_name": "'Jornal ' || CAST(user_id % 23 AS VARCHAR(9))",
    "status": by_value("event_type", {
        "click": "ready_for_classification", "view": "discarded", "error": "failed_in_download",
        "signup": "extracting", "purchase": "extracted"}),
    "is_violent_death": "CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "city": "'cidade ' || CAST(user_id AS VARCHAR(9))",
    "user_id": "user_id",
    "results": "CAST((event_id * 7) % 120 AS BIGINT)",
    "value": "value",
    "props": "props",
    "fetched_at": "ts",
    "updated_at": "ts",
}

ATTEMPT = {
    "id": "event_id",
    "source_google_news_id": "user_id",
    "stage": by_value("event_type", {
        "click": "download", "view": "download", "error": "content_gate", "signup": "extraction", "purchase": "extraction"}),
    "outcome": pick("event_id", ["success", "failure", "discarded", "failure"]),
    "failure_reason": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE " + pick("event_id", REASONS) + " END",
    "http_status": "CAST(" + pick("event_id", ["200", "404", "503", "429", "301"]) + " AS INT)",
    "duration_s": "value",
    "content_length": "(event_id * 3701) % 3000000",
    "created_at": "ts",
}

# frequent invented words -> domain wording, so that the text rules have work to do
WORDING = [
    (" von ", " balanço anual "), (" el ", " suicídio "), (" les ", " terremoto na venezuela "),
    (" den ", " troca de tiros com a policia "), (" pour ", " feminicidio "), (" que ", " tres mortos e 2 feridos "),
    (" und ", " carabineros "), (" this ", " corpo encontrado "), (" from ", " golpes de faca "),
    (" are ", " hospital "), (" with ", " baleado "), (" by ", " foi executado "), (" et ", " chacina "),
    (" zu ", " polícia "), (" des ", " faleceu "), (" was ", " nao conseguiu determinar "),
    (" une ", " neste domingo "), (" der ", " domingo (10) "),
]


def reworded(column: str) -> str:
    out = column
    for old, new in WORDING:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


ARTICLE = {
    "id": "doc_id",
    "content": reworded("text"),
    "publisher_name": "source",
    "lang": "lang",
    "status": pick("doc_id", ["extracted", "discarded", "ready_for_extraction", "extracted", "failed_in_extraction"]),
    "is_violent_death": "CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "published_at": "CAST('2024-03-10 12:00:00' AS TIMESTAMP)",
    "updated_at": "CAST('2024-03-10 12:00:00' AS TIMESTAMP)",
    "resolved_url": "'https://www.' || source || '.example.com/' || CAST(doc_id AS VARCHAR(19))",
}
HEADLINE = {
    "conv_id": "conv_id",
    "turn": "turn",
    "role": "role",
    "headline": reworded("text"),
}
SCORED = {
    "id": "doc_id",
    "expected": "quality = 1",
    "actual": "toxic = 0",
    "passed": "(quality = 1) = (toxic = 0)",
    "error": "CASE WHEN doc_id % 50 = 0 THEN 'timeout' END",
    "stage": pick("doc_id", ["classification", "extraction"]),
    "fixture": pick("doc_id", ["seed", "hard", "regression"]),
    "tag": "'t' || CAST(doc_id % 5 AS VARCHAR(9))",
    "tag2": "'p' || CAST(quality AS VARCHAR(9))",
}
CITY_RUN = {
    "city": "c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR(9))",
    "country": "CASE WHEN c_nationkey >= 20 THEN 'CL' ELSE 'BR' END",
}


def _select(columns: dict[str, str]) -> str:
    return ",\n  ".join(f"{expr} AS {name}" for name, expr in columns.items())


def spark_exprs(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


# Reports of incidents in free wording: most pairs of a half month and city tell of different incidents, some
# share a name (of two to four parts), a title, parts of a title or description, or a circumstance.
_MIX = "(o_orderkey * 7919 + o_custkey * 104729)"
_PRICE = "CAST(floor(o_totalprice) AS BIGINT)"
SUBJECTS = ["Homem", "Mulher", "Jovem de 19 anos", "Adolescente", "Policial militar de folga", "Casal", "Motorista de aplicativo", "Ex-vereador"]
DEEDS = ["é morto a tiros", "é encontrado sem vida", "morre após briga", "é executado por encapuzados", "desaparece e é achado em cova rasa"]
SPOTS = ["no centro", "na zona norte da capital", "dentro de bar", "às margens da rodovia", "em frente de casa", "num terreno baldio",
         "na saída de uma festa", "perto da escola municipal", "em loja de peças", "no cais do porto", "durante o velório do primo"]
MEANS = ["12 tiros", "uma faca de cozinha", "golpes de machado", "15 facadas", "arma de grosso calibre", "uma corda", "35 disparos", "pedradas",
         "um único disparo no peito", "veneno no café", "barra de ferro"]
TOLD = ["Moradores ouviram gritos por volta das", "A polícia foi chamada às", "O corpo estava na sala; vizinhos notaram algo às",
        "Câmeras mostram dois suspeitos fugindo às", "Segundo a família, tudo começou às", "Testemunhas contam que o crime ocorreu às"]
ENDS = ["ninguém foi preso", "um suspeito se entregou horas depois", "a delegacia investiga vingança", "o filho da vítima viu tudo na kitnet",
        "a esposa e o filho escaparam", "a motivação seria dívida de jogo", "o caso corre em sigilo", "exames ainda não ficaram prontos",
        "cinco homens armados são procurados"]
_PART = "CASE WHEN {0} % 3 = 0 THEN '' WHEN {0} % 3 = 1 THEN ' da' ELSE ' ' || " + pick("{0} // 5", ["Neto", "Alves", "Batista", "Moura"]) + " END"
REPORT = {
    "id": "o_orderkey",
    "content_class": "'incident'",
    "event_date": "CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN extract(day FROM o_orderdate) > 15"
                  " THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL '15' DAY ELSE CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) END",
    "city": "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR(9)) END",
    "neighborhood": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Vila ' || " + pick("o_custkey", ["Nova", "Rica", "São José", "das Flores", "Operária"]) + " END",
    "title": f"CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE {pick(_MIX, SUBJECTS)} || ' ' || {pick(_MIX + ' // 8', DEEDS)} || ' '"
             f" || {pick(_PRICE, SPOTS)} || CASE WHEN o_orderkey % 9 = 0 THEN ', diz polícia' ELSE '' END END",
    "chronological_description": f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {pick(_PRICE + ' // 11', TOLD)} || ' ' || CAST({_MIX} % 24 AS VARCHAR(9))"
                                 f" || 'h; a vítima foi atingida com ' || {pick(_MIX + ' // 40', MEANS)} || ' e ' || {pick(_PRICE + ' // 66', ENDS)} END",
    "victims_summary": "CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE " + pick("o_custkey", FIRST_NAMES) + " || " + _PART.format("(o_custkey // 3)")
                       + " || ' ' || " + pick("o_custkey // 11", LAST_NAMES) + " || CASE WHEN o_custkey % 4 = 0 THEN ' Filho' ELSE '' END END",
    "source_count": "CAST(1 + o_orderkey % 4 AS INT)",
}

_RAW_SQL = (
    "SELECT " + _select(RAW) + f" FROM (SELECT *, {RAW_ID_SQL} AS raw_id FROM lineitem) l JOIN supplier ON l_suppkey = s_suppkey"
)
SQL_VIEWS = {
    "incident": "SELECT " + _select(INCIDENT) + " FROM orders JOIN customer ON o_custkey = c_custkey",
    "raw": _RAW_SQL,
    "report": "SELECT " + _select(REPORT) + " FROM orders JOIN customer ON o_custkey = c_custkey",
    "source": "SELECT " + _select(SOURCE) + " FROM events",
    "attempt": "SELECT " + _select(ATTEMPT) + " FROM events",
    "article": "SELECT " + _select(ARTICLE) + " FROM documents",
    "headline": "SELECT " + _select(HEADLINE) + " FROM conversations",
    "scored": "SELECT " + _select(SCORED) + " FROM labels",
}


def with_views(body: str, *names: str) -> str:
    """Checking SQL with the named stand-in views as common table expressions."""
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    joined = body.lstrip()
    if joined.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{joined[len('WITH RECURSIVE'):].lstrip()}"
    if joined.upper().startswith("WITH "):
        return f"WITH {views},\n{joined[len('WITH '):].lstrip()}"
    return f"WITH {views}\n{joined}"


class Archive:
    """The stand-in tables of one data folder, built lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def incident(self) -> DataFrame:
        base = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return base.selectExpr(*spark_exprs(INCIDENT))

    @cached_property
    def report(self) -> DataFrame:
        base = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        spark_form = {name: expr.replace(" // ", " DIV ") for name, expr in REPORT.items()}
        people = F.array().cast("array<struct<name:string>>")
        return base.selectExpr(*spark_exprs(spark_form)).withColumn("people", people)

    @cached_property
    def raw(self) -> DataFrame:
        lines = self.table("lineitem").withColumn("raw_id", F.expr(RAW_ID_SPARK))
        base = lines.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return base.selectExpr(*spark_exprs(RAW))

    @cached_property
    def source(self) -> DataFrame:
        return self.table("events").selectExpr(*spark_exprs(SOURCE))

    @cached_property
    def attempt(self) -> DataFrame:
        return self.table("events").selectExpr(*spark_exprs(ATTEMPT))

    @cached_property
    def article(self) -> DataFrame:
        out = self.table("documents").selectExpr(*spark_exprs(ARTICLE))
        return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("published_at", "updated_at")})

    @cached_property
    def headline(self) -> DataFrame:
        return self.table("conversations").selectExpr(*spark_exprs(HEADLINE))

    @cached_property
    def scored(self) -> DataFrame:
        return self.table("labels").selectExpr(*spark_exprs(SCORED)).withColumn("tags", F.array("tag", "tag2"))

    @cached_property
    def named_raw(self) -> DataFrame:
        """Records with their folded victim names as an array."""
        from casebook.functions.text import fold

        names = F.when(F.col("name").isNotNull(), F.array(fold(F.col("name")))).otherwise(F.array().cast("array<string>"))
        return self.raw.withColumn("names", names)

    @cached_property
    def named_incident(self) -> DataFrame:
        """Incidents with nested people and the names they are known by."""
        from casebook.functions.names import incident_names

        people = F.array().cast("array<struct<name:string>>")
        return self.incident.withColumn("people", people).withColumn(
            "names", incident_names(F.col("victims_summary"), F.col("people"))
        )
