"""Text documents rendered per record for an external model step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _place(neighborhood: Column, city: Column, state: Column) -> Column:
    parts = [F.nullif(p, F.lit("")) for p in (neighborhood, city, state)]
    return _or(F.concat_ws(", ", *parts), "Não especificado")


def _day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("Não especificada"))


def _labelled(rows: list[tuple[str, Column]]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {label}: "), value) for label, value in rows])


def record_document(
    id_: Column, names: Column, neighborhood: Column, city: Column, state: Column,
    event_date: Column, label: Column, description: Column, title: Column,
) -> Column:
    """Article-level record as labelled lines."""
    who = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("Não identificado")
    return _labelled([
        ("ID", id_.cast("string")),
        ("Vítima(s)", who),
        ("Local", _place(neighborhood, city, state)),
        ("Data", _day(event_date)),
        ("Tipo", _or(label, "Não especificado")),
        ("Descrição", F.coalesce(F.nullif(description, F.lit("")), _or(title, "Sem descrição"))),
    ])


def incident_document(
    id_: Column, summary: Column, neighborhood: Column, city: Column, state: Column,
    event_date: Column, label: Column, description: Column, title: Column, source_count: Column,
) -> Column:
    """Canonical incident as labelled lines."""
    return _labelled([
        ("ID", id_.cast("string")),
        ("Vítima(s)", _or(summary, "Não identificado")),
        ("Local", _place(neighborhood, city, state)),
        ("Data", _day(event_date)),
        ("Tipo", _or(label, "Não especificado")),
        ("Descrição", F.coalesce(F.nullif(description, F.lit("")), _or(title, "Sem descrição"))),
        ("Fontes", F.coalesce(source_count.cast("string"), F.lit("None"))),
    ])


def numbered(documents: Column, kind: str) -> Column:
    """'1. kind:' blocks of an ordered array of documents."""
    blocks = F.transform(
        documents, lambda d, i: F.concat((i + 1).cast("string"), F.lit(f". {kind}:\n"), d)
    )
    return F.array_join(blocks, "\n\n")


def match_document(record: Column, candidates: Column) -> Column:
    return F.concat(
        F.lit("EXTRAÇÃO (RawEvent):\n"), record,
        F.lit("\n\nEVENTOS CANDIDATOS (UniqueEvents):\n"), numbered(candidates, "UniqueEvent"),
    )


def cluster_document(records: Column) -> Column:
    return F.concat(F.lit("EXTRAÇÕES:\n"), numbered(records, "Extração"))


def extraction_document(
    content: Column, published: Column, headline: Column, publisher: Column, url: Column
) -> Column:
    """Article with a metadata header; absent metadata leave no line."""

    def line(label: str, value: Column, tail: str = "\n") -> Column:
        filled = F.nullif(value, F.lit(""))
        return F.when(filled.isNotNull(), F.concat(F.lit(f"**{label}:** "), filled, F.lit(tail)))

    note = F.when(
        published.isNotNull(),
        F.lit(
            "(Use esta data como referência para resolver datas relativas / "
            "Use esta fecha como referencia para resolver fechas relativas)\n"
        ),
    )
    return F.concat_ws(
        "\n",
        F.lit("## METADADOS DA NOTÍCIA / METADATOS DE LA NOTICIA\n"),
        line("Data de Publicação / Fecha de Publicación", published.cast("string"), ""),
        note,
        line("Manchete / Titular", headline),
        line("Fonte / Medio", publisher),
        line("URL", url),
        F.lit("\n## CONTEÚDO DA NOTÍCIA / CONTENIDO DE LA NOTICIA\n"),
        content,
    )


def fusion_document(state: Column, sources: Column) -> Column:
    """Current incident fields followed by its numbered sources.

    `state` is a struct of the eight fields, `sources` an ordered array of
    struct(publisher, headline, url, content).
    """
    labels = [
        ("Título", "title"), ("Data", "event_date"), ("Cidade", "city"), ("Estado", "state"),
        ("Bairro", "neighborhood"), ("Rua", "street"), ("Vítimas", "victims_summary"),
        ("Descrição", "chronological_description"),
    ]
    head = _labelled([(label, F.coalesce(state[f].cast("string"), F.lit("None"))) for label, f in labels])
    blocks = F.transform(
        sources,
        lambda s, i: F.concat(
            F.lit("\n"), (i + 1).cast("string"), F.lit(". Fonte: "), _or(s["publisher"], "Desconhecida"),
            F.lit("\n   Manchete: "), _or(s["headline"], "N/A"),
            F.lit("\n   URL: "), _or(s["url"], "N/A"),
            F.lit("\n   Conteúdo: "), F.coalesce(s["content"], F.lit("")), F.lit("\n"),
        ),
    )
    return F.concat(
        F.lit("ESTADO ATUAL DO EVENTO:\n"), head,
        F.lit("\n\nFONTES DE NOTÍCIAS ("), F.size(sources).cast("string"), F.lit(" fontes):\n"),
        F.array_join(blocks, ""),
    )
