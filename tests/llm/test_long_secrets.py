"""Tokens of any length take part in the ownership method."""

import random
import string

from casebook.llm import secrets


def test_long_tokens_are_counted_and_masked(spark):
    draw = random.Random(5)
    token = lambda n: "aB3" + "".join(draw.choice(string.ascii_letters + string.digits + "-_") for _ in range(n - 3))
    key, head, claims, signature, example = token(164), token(36), token(300), token(342), token(200)
    rows = [(1, f"key {key} here", "a"), (2, f"jwt {head}.{claims}.{signature} end", "a"), *[(i, f"copied {example} x", f"s{i}") for i in (3, 4, 5)]]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(docs)).collect()}
    assert spans == {1: "own:4:168", 2: "own:4:40,own:41:341,own:342:684", 3: "", 4: "", 5: ""}
    safe = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert safe == {1: "key [SECRET] here", 2: "jwt [SECRET].[SECRET].[SECRET] end", **{i: f"copied {example} x" for i in (3, 4, 5)}}


def test_a_value_inside_another_leaves_no_tail(spark):
    short = "Qw3Er5Ty7Ui9Op1As2Df"
    texts = [(i, f"x {short}77Tail88Secret y {short} z", "en", "one") for i in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    assert {r["text"] for r in secrets.redact(docs).collect()} == {"x [SECRET] y [SECRET] z"}
