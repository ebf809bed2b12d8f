"""The queries against their checking SQL and plain Python forms, on test tables and on edge cases."""

import os
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from conftest import DOCUMENTS, PAGES, duck  # noqa: E402

from casebook.llm import catalog  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


@pytest.fixture(params=["small", "edge", "empty"])
def folder(request, edge_folder, empty_folder):
    if request.param == "small" and not os.path.isdir(SMALL):
        pytest.skip("test tables not present")
    return {"small": SMALL, "edge": edge_folder, "empty": empty_folder}[request.param]


def rows_of(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def documents(folder, columns):
    return duck(folder).execute(f"SELECT {columns} FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, folder, name):
    got = QUERIES[name](spark, folder)
    cursor = duck(folder).execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(map(str, cursor.fetchall()))
    assert Counter(str(tuple(r[n] for n in names)) for r in got.collect()) == want


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(folder, "doc_id, text")
    rows = rows_of(spark, "op1_pack", folder)
    once = Counter(d for d, _ in docs)
    single = [(d, t) for d, t in docs if once[d] == 1]
    kept = [r for r in rows if once[r["doc_id"]] == 1]
    for sequence in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == sequence)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    ids_of = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    if len(single) == len(docs):
        assert brute.check_packing(docs, rows, ids_of) < 0.02
    else:
        pieces = [dict(r, sequence_id=i, offset=0) for i, r in enumerate(kept)]
        brute.check_packing(single, pieces, ids_of)
        assert sum(r["length"] for r in rows) == sum(len(ids_of(t or "")) + 1 for _, t in docs)


def test_quality_counts(spark, folder):
    want = Counter()
    for d, t in documents(folder, "doc_id, text"):
        counts = brute.quality_counts(t)
        want[d, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]] += 1
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows_of(spark, "op2_quality_rules", folder))
    assert got == want


def test_quality_agrees_with_labels(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("test tables not present")
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows_of(spark, "op2_quality_rules", folder)}
    import duckdb

    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall()
    judged = [(q, got[d]["kept"]) for d, q in labels if not got[d]["base_failed"]]
    assert sum(bool(q) == kept for q, kept in judged) >= 0.98 * len(judged)


def test_mix(spark, folder):
    docs = documents(folder, "doc_id, source, text")
    rows = rows_of(spark, "op3_mix", folder)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, len(brute.words(t))) for d, _, t in docs)
    if len({d for d, *_ in docs}) == len(docs):
        brute.check_mix(docs, rows)
    positions = [r["position"] for r in rows if r["position"] is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)


def test_urls(spark, folder):
    pages = duck(folder).execute("SELECT page_id, url FROM pages").fetchall()
    rows = rows_of(spark, "op4_url_filter", folder)
    want = Counter((p, *brute.url_parts(u)[:3]) for p, u in pages)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows) == want
    by_rule = {h + p: v for h, p, v in brute.RULES}
    assert all(r["verdict"] == by_rule[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block") for r in rows)


def test_secrets(spark, folder):
    want = Counter((d, *brute.secret_row(t)) for d, t in documents(folder, "doc_id, text"))
    rows = rows_of(spark, "op6_secrets", folder)
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == want


def test_secret_ownership(spark, edge_folder):
    spans = {r["doc_id"]: r["spans"] for r in rows_of(spark, "op6_secrets", edge_folder)}
    assert spans[15] == "own:5:27"  # held by one owner
    assert spans[16] == spans[17] == spans[18] == ""  # copied by three owners
    assert spans[14].startswith("hex:1:33")


def test_lm_base(spark, folder):
    docs = documents(folder, "doc_id, text")
    rows = rows_of(spark, "op7_lm_score", folder)
    assert len(rows) == len(docs) and all(r["score"] < 0 for r in rows)
    if len({d for d, _ in docs}) == len(docs):
        want = brute.unigram(docs)
        for r in rows:
            held, n, known, total, base = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
            assert r["base_score"] == pytest.approx(base, rel=1e-9)


def test_simhash(spark, folder):
    docs = documents(folder, "doc_id, text")
    prints = [(d, brute.fingerprint(t)) for d, t in docs]
    want = Counter((d, f"{p:016x}", c) for (d, p), (_, c) in zip(prints, brute.components(prints), strict=True))
    rows = rows_of(spark, "op9_simhash", folder)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want


def test_article_text(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("test tables not present")
    html = dict(duck(SMALL).execute("SELECT page_id, html FROM pages").fetchall())
    for r in rows_of(spark, "op10_html", SMALL):
        assert r["text"] == brute.article_text(html[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def test_page_text_on_edge_cases(spark, edge_folder):
    got = {r["page_id"]: r["text"] for r in rows_of(spark, "op10_html", edge_folder)}
    assert len(got) == len(PAGES)
    assert got[1] == "Title One <two> three four"
    assert got[2] == got[3] == got[10] == ""
    assert got[4] == "just text"
    assert got[5] == "First story"  # what it shares with the nearest page is gone
    assert (got[6], got[7]) == ("Second story", "Third story")
    assert got[8] == "in"
    assert got[9] == "unfinished <b"
    assert got[None] == "xy z é"


def test_warc(spark, folder):
    import hashlib
    import json

    pages = duck(folder).execute("SELECT page_id, url, html FROM pages").fetchall()
    rows = rows_of(spark, "op8_warc", folder)
    assert Counter((r["page_id"], r["warc_type"]) for r in rows) == Counter((p, k) for p, _, _ in pages for k in ("metadata", "conversion"))
    source = {p: (u or "", h or "") for p, u, h in pages}
    sha = lambda text: "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    by_page = {}
    for r in rows:
        url, html = source[r["page_id"]]
        assert r["target_uri"] == url and r["source_digest"] == sha(html)
        assert r["block_digest"] == sha(r["content"]) and r["content_length"] == len(r["content"].encode())
        by_page.setdefault(r["page_id"], {})[r["warc_type"]] = r
    for p, pair in by_page.items():
        meta, text = pair["metadata"], pair["conversion"]
        assert meta["refers_to"] == text["refers_to"] not in (meta["record_id"], text["record_id"])
        assert meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
        assert json.loads(meta["content"])["payload_digest"] == meta["source_digest"]
        assert brute.article_text(source[p][1]) == "" or folder != SMALL or brute.article_text(source[p][1])[:20] in text["content"].replace("\n", " ")


def test_warc_records_read_back(spark, edge_folder):
    from casebook.llm import warc

    derived = QUERIES["op8_warc"](spark, edge_folder)
    want = {r["record_id"]: r for r in derived.collect()}
    for row in warc.rendered(derived).collect():
        head, rest = row["record"].encode().split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert rest[size:] == b"\r\n\r\n"
        own = want[fields["WARC-Record-ID"]]
        assert rest[:size].decode() == own["content"] and fields["WARC-Refers-To"] == own["refers_to"]


def _plain(df):
    return [r.asDict() for r in df.collect()]


def test_pipeline_stages(spark, edge_folder, empty_folder):
    import corpus_pipeline as pipeline

    for folder in (edge_folder, empty_folder):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == columns
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet")
    kept = _plain(pipeline.quality_rules(spark, docs, edge_folder))
    assert {1, 2, 3, 21} <= {r["doc_id"] for r in kept} and not {4, 5, 6, 7, 10, 11} & {r["doc_id"] for r in kept}
    single = _plain(pipeline.near_dedup(spark, docs, edge_folder))
    prints = [(d, brute.fingerprint(t)) for d, t, *_ in DOCUMENTS]
    components = brute.components(prints)
    alone = sum(d is None and c is None for d, c in components)  # no id in the whole component
    assert Counter(r["doc_id"] for r in single) == Counter({c for _, c in components} - {None}) + Counter({None: alone})
    safe = {r["doc_id"]: r for r in _plain(pipeline.secret_scan(spark, docs, edge_folder)) if r["doc_id"]}
    assert safe[12]["text"] == '[SECRET]" and token=abc and [SECRET]' and safe[12]["n_chars"] == len(safe[12]["text"])
    assert safe[15]["text"] == "live [SECRET] here" and safe[16]["text"].startswith("copied Example1")
    assert safe[4]["text"] is None and safe[1]["size"] == "size0"
    planned = Counter()
    for r in _plain(catalog.mixing.mix(docs)):
        planned[r["doc_id"]] += r["copies"]
    mixed = Counter(r["doc_id"] for r in _plain(pipeline.source_mix(spark, docs, edge_folder)))
    assert mixed == +planned


def test_pipeline_equals_brute_force(spark):
    """run() against the stages remade in plain Python (quality verdicts by SQL)."""
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    if not os.path.isdir(SMALL):
        pytest.skip("test tables not present")
    con = duck(SMALL)
    kept = con.execute(f"SELECT doc_id FROM ({catalog.oracle_sql()['op2_quality_rules']}) WHERE kept").fetchall()
    kept = {d for d, in kept}
    docs = [r for r in con.execute("SELECT doc_id, source, text FROM documents").fetchall() if r[0] in kept]
    first = {c for _, c in brute.components([(d, brute.fingerprint(t)) for d, _, t in docs])}
    docs = [(d, s, brute.redacted(t)) for d, s, t in docs if d in first]
    copies = brute.mix_copies(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, crcs = Counter(), {}
    for (d, _, t), n in zip(docs, copies, strict=True):
        if n:
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
            want[d] = n * len(ids)
            crcs[d] = ids
    got = Counter()
    for r in _plain(pipeline.run(spark, SMALL)):
        got[r["doc_id"]] += r["length"]
        own = crcs[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == brute.binascii.crc32(b"".join(i.to_bytes(4, "little") for i in own))
    assert got == want


def test_extra_columns_survive_null_text(spark, edge_folder):
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet").withColumn("source", F.lit(None).cast("string"))
    assert catalog.mixing.mix(docs).count() == len(DOCUMENTS)
