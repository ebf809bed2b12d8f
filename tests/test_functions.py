"""Scalar rules on small hand-made inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casebook.functions import corrections, dates, failures, names, payload, places, similarity, taxonomy, text
from casebook.functions.judges import ratio


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, value, fn, kind="string"):
    return values(spark, [(value,)], f"v {kind}", fn(F.col("v")).alias("o"))[0][0]


@pytest.mark.parametrize("raw, folded", [
    ("  Homicídio\n  em São  Paulo ", "homicidio em sao paulo"),
    ("ÑUÑOA Çelik", "nunoa celik"),
    (None, ""),
])
def test_fold(spark, raw, folded):
    assert one(spark, raw, text.fold) == folded


def test_split_headline_uses_last_separator(spark):
    got = values(spark, [("A - B - Jornal",), ("Sem fonte",)], "v string", text.split_headline(F.col("v")).alias("s"))
    assert [tuple(r[0]) for r in got] == [("A - B", "Jornal"), ("Sem fonte", None)]


@pytest.mark.parametrize("headline, negative, positive", [
    ("Jovem sobrevive a ataque", True, False),
    ("Homem não resistiu e morre no hospital", False, False),
    ("Corpo amarrado é achado", False, True),
    ("PM troca tiros com suspeitos", True, False),
    ("PM troca tiros e dois são neutralizados", False, True),
    ("Ataque a tiros no Texas", True, False),
    ("Prefeitura executa o orçamento", True, False),
])
def test_headline_rules(spark, headline, negative, positive):
    got = values(spark, [(headline,)], "v string", text.forced_negative(F.col("v")), text.forced_positive(F.col("v")))
    assert got == [(negative, positive)]


@pytest.mark.parametrize("content, rule", [
    ("Balanço anual das mortes", "annual_balance"),
    ("O CVLI registra 2023", "cvli_year_report"),
    ("Foram 1.234 vítimas", "large_victim_total"),
    ("Terremoto atinge a Venezuela", "foreign_earthquake"),
    ("caso de suicídio", "suicide"),
    ("cachorro foi morto", "animal_cruelty"),
    ("homem morto a tiros", None),
])
def test_article_rules(spark, content, rule):
    got = values(spark, [(content,)], "v string", text.article_rule(F.col("v")).getField("rule"))
    assert got == [(rule,)]


@pytest.mark.parametrize("content, method", [
    ("morto a tiros na rua", "Arma de fogo"), ("golpes de faca", "Arma branca"),
    ("foi estrangulada", "Estrangulamento"), ("nada dito", None),
])
def test_method(spark, content, method):
    assert one(spark, content, lambda c: corrections.method_of_death(text.lower_fold(c))) == method


def test_hypothesis_lookahead(spark):
    near = "a hipotese e de que foi executado"
    far = "a hipotese " + "x" * 200 + " executado"
    assert one(spark, near, corrections.hypothesis_only) is True
    assert one(spark, far, corrections.hypothesis_only) is False


@pytest.mark.parametrize("content, count", [
    ("tres mortos e 2 feridos", 3), ("ataque deixa 2 mortos e um ferido", 2), ("25 mortos e 2 feridos", None), ("nada", None),
])
def test_fatal_count(spark, content, count):
    assert one(spark, content, corrections.fatal_count) == count


def test_date_fixes(spark):
    published = dt.datetime(2024, 2, 18)
    rows = [("no domingo (10)", published), ("no sábado (31)", published), ("neste domingo", published), ("nesta segunda-feira", published)]
    got = values(spark, rows, "c string, p timestamp", corrections.date_fix(F.col("c"), F.col("p"), F.lit("2024-02-01")))
    assert got == [("2024-02-10",), (None,), ("2024-02-18",), (None,)]


@pytest.mark.parametrize("label, pair", [
    ("Homicídio", ("homicidio", "simples")),
    ("Tentativa de Feminicídio", ("tentativa", "feminicidio")),
    ("Homicídio culposo no trânsito", ("acidente_fatal", "transito_culposo")),
    ("acidente", ("nao_classificado", "outro")),
    ("culposo", ("acidente_fatal", "culposo")),
    (None, ("nao_classificado", "outro")),
])
def test_legacy_labels(spark, label, pair):
    assert tuple(one(spark, label, taxonomy.legacy_to_pair)) == pair


@pytest.mark.parametrize("url, domain", [
    ("https://www.G1.globo.com/x?y", "g1.globo.com"), ("not a url", None), (None, None), ("http://a.b:80/", "a.b"),
])
def test_url_domain(spark, url, domain):
    assert one(spark, url, failures.url_domain) == domain


@pytest.mark.parametrize("name, message, reason", [
    ("IncompleteOutputException", "", "llm_max_tokens"), ("X", "429 quota", "llm_quota"), ("X", "rate limit", "llm_rate_limit"),
    ("X", "deadline exceeded", "llm_timeout"), ("X", "context window", "content_too_long"), ("X", "?", "llm_unknown"),
])
def test_extraction_reason(spark, name, message, reason):
    got = values(spark, [(name, message)], "n string, m string", failures.extraction_reason(F.col("n"), F.col("m")))
    assert got == [(reason,)]


@pytest.mark.parametrize("value, parsed", [
    ("2024-01-02 03:04:05.123456", dt.datetime(2024, 1, 2, 3, 4, 5, 123456)), ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02", dt.datetime(2024, 1, 2)), ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)), ("06/07/2026 às 10:00", None),
])
def test_parse_timestamp(spark, value, parsed):
    assert one(spark, value, lambda c: dates.parse_timestamp(c).cast("timestamp_ntz")) == parsed


def test_plus_code_vectors(spark):
    rows = [(20.375, 2.775), (20.3700625, 2.7821875), (47.0000625, 8.0000625), (-41.2730625, 174.7859375), (0.5, -179.5)]
    got = values(spark, rows, "a double, b double", places.plus_code(F.col("a"), F.col("b")))
    assert got[1][0] == "7FG49QCJ+2V"
    assert got[2][0] == "8FVC2222+22"
    assert got[3][0] == "4VCPPQGP+Q9"
    assert len(got[4][0]) == 11


def test_haversine(spark):
    got = values(spark, [(-23.55, -46.63, -22.91, -43.17)], "a double, b double, c double, d double",
                 places.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert got[0][0] == pytest.approx(360.8, abs=1.0)


def test_geocoder_result(spark):
    result = ('{"types":["route"],"geometry":{"location":{"lat":-10.0,"lng":-50.0},"location_type":"GEOMETRIC_CENTER"},'
              '"formatted_address":"Rua A","place_id":"p"}')
    got = values(spark, [(result, "centro do bairro")], "r string, g string", places.geocode_fields(F.col("r"), F.col("g")).alias("x"))[0][0]
    assert (got.location_precision, got.geocoding_confidence, got.zoom) == ("centro do bairro", 0.55, 13.0)
    assert got.plus_code.endswith("+22")


def test_name_keys(spark):
    def keys(name):
        return set(one(spark, name, names.name_keys))

    assert keys("João da Silva Souza, 32 anos") == {"joao da silva souza", "joao souza", "joao silva", "silva souza"}
    assert keys("Wal") == {"wal"}
    assert keys("uma mulher trans de 45 anos") == set()
    assert keys("vítima Maria (conhecida) Lima foi encontrada na rua") >= {"maria lima"}
    assert keys("x1") == set()


def test_key_overlap(spark):
    rows = [(["joao silva"], ["joao silva souza"]), (["ana"], ["ana maria"]), (["ana"], ["ana"]), ([], ["ana"])]
    got = values(spark, rows, "a array<string>, b array<string>", names.keys_overlap(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, False, True, False]


def test_tri_state_and_join(spark):
    rows = [([True, None],), ([False, False],), ([False, None],), ([],)]
    assert [r[0] for r in values(spark, rows, "v array<boolean>", payload.tri_state(F.col("v")))] == [True, False, None, None]
    assert one(spark, [" a ", "", None, "b"], payload.join_nonempty, "array<string>") == "a; b"


def test_violations(spark):
    record = (
        '{"event_family":"homicidio","event_subtype":"culposo","date_time":{"date":"2024-01-01","date_verification":{"has_explicit_date":true,'
        '"date_source":"none"}},"victims":{"identifiable_victims":[{"name":"a"}],"number_of_identifiable_victims":2,'
        '"unidentified_groups":[{"count":3}],"number_of_unidentified_victims":1,"number_of_victims":25}}'
    )
    found = one(spark, record, lambda c: payload.violations(payload.parse(c)))
    assert {v.rule for v in found} == {
        "victims_identified_count", "victims_unidentified_count", "victims_total", "victims_range",
        "date_without_source", "subtype_not_in_family",
    }


def test_unparsable_record_gives_nulls(spark):
    fields = one(spark, "not json", lambda c: payload.public_fields(payload.parse(c)))
    assert set(fields.asDict().values()) == {None}


def test_json_paths(spark):
    assert one(spark, '{"a":{"b":"c"}}', lambda c: payload.json_path(c, "a.b")) == "c"
    assert one(spark, "{bad", lambda c: payload.variant_path(c, "a.b")) is None


def test_ratio_counts_frequent_letters_of_long_texts_and_udf_agrees(spark):
    a, b = "ab" * 150, "ba" * 140 + "xyz"
    got = values(spark, [(a, b), (b, a)], "a string, b string", similarity.sequence_ratio(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [ratio(a, b), ratio(b, a)]
    assert min(g[0] for g in got) > 0.9


def test_language_and_words(spark):
    assert one(spark, "El asesinato fue ayer , dijo carabineros", text.language_vote) == "es"
    assert one(spark, "o homem foi morto ontem no bairro central", text.language_vote) == "pt"
    got = values(spark, [("Tiros na praça central", "Morte na praça central")], "a string, b string", text.shared_words(F.col("a"), F.col("b")))
    assert got[0][0] == ["central", "praça"]


def test_postal_and_region(spark):
    assert one(spark, "01310 100", places.postal_code) == "01310-100"
    assert one(spark, "123", places.postal_code) is None
    assert one(spark, "RM", lambda c: taxonomy.region_key(F.lit("CL"), c)) == "Metropolitana"
    assert one(spark, "sp", lambda c: taxonomy.region_key(F.lit("BR"), c)) == "SP"


def test_cues_fold_their_text_once(spark):
    df = spark.createDataFrame([("A vítima levou 15 tiros dentro da kitnet alugada no bairro",), ("15 tiros",), (None,)], "t string")
    got = df.select(names.context_cues(names.context_text(F.col("t"), F.lit(None), F.lit(None))).alias("cues"))
    assert [r["cues"] for r in got.collect()] == [3, 0, 0]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_record_text_is_made_once(spark):
    """A record that is written as JSON and parsed back is written once, and odd texts stay NULL."""
    from casebook.functions import payload

    rows = spark.createDataFrame([(1, "a")], "id int, event_family string")
    written = rows.select(payload.parse(F.to_json(F.struct("event_family"))).alias("r"))
    assert written._jdf.queryExecution().analyzed().toString().count("to_json(") == 1
    assert written.first()["r"]["event_family"] == "a"
    odd = spark.createDataFrame([(t,) for t in (None, "", "[]", "{", ' {"event_family": "b"}')], "t string")
    assert [r[0] for r in odd.select(payload.parse(F.col("t"))["event_family"]).collect()] == [None] * 4 + ["b"]
