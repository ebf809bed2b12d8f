"""Tokenizer alignment against plain loops over both tokenizers' ids."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest

from casebook.llm import alignment, catalog

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HARD = [
    (1, "a  b\n\n\tc  "), (2, "▁x ▁"), (3, "<s>x</s> <|endoftext|> <0x41><unk>"), (4, "é é ﬁ Å"), (5, "日本語 テキスト 🙂🙂"), (6, "\x00\x01\x1c \x85"),
    (7, None), (8, ""), (9, " "), (10, "   lead"), (11, "1234567 don't DON'T it's"), (12, "x" * 500), (12, "a b"), (13, "the the the the"), (None, "the end"),
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(tokenizers, text):
    a, b = tokenizers
    if not text:
        return [], []
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    of_a = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        of_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in of_a) != whole or b"".join(x for _, x in of_b) != whole:
        return [], []
    return of_a, of_b


def ranges(found):
    at = 0
    for i, x in found:
        yield i, at, at + len(x)
        at += len(x)


def brute(tokenizers, docs):
    rows, links, holders = [], [], Counter()
    for _, text in docs:
        of_a, of_b = (list(ranges(x)) for x in tokens(tokenizers, text))
        own = [(i, j) for i, s, e in of_a for j, u, v in of_b if s < v and u < e] if len(of_a) < 2000 else fast_links(of_a, of_b)
        links.append(own)
        holders.update(set(own))
        groups, cuts = [], sorted({e for *_, e in of_a} & {e for *_, e in of_b})
        low = 0
        for cut in cuts:
            of = lambda found: ",".join(str(i) for i, s, e in found if low < e <= cut)  # noqa: B023, E731
            groups.append(f"{of(of_a)}|{of(of_b)}" if len(of_a) < 2000 else (low, cut))
            low = cut
        if len(of_a) >= 2000:
            groups = fast_groups(of_a, of_b)
        rows.append((len(of_a), len(of_b), len(groups), ";".join(groups)))
    best = defaultdict(int)
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return [
        (doc, a, b, g, len(own), sum(holders[p] == best[p[0]] for p in own), sum(holders[p] for p in own),
         hashlib.sha256(text.encode()).hexdigest() if a else "")
        for (doc, _), (a, b, g, text), own in zip(docs, rows, links, strict=True)]


def fast_links(of_a, of_b):
    out, j = [], 0
    for i, s, e in of_a:
        while of_b[j][2] <= s:
            j += 1
        k = j
        while k < len(of_b) and of_b[k][1] < e:
            out.append((i, of_b[k][0]))
            k += 1
    return out


def fast_groups(of_a, of_b):
    ends = {e for *_, e in of_a} & {e for *_, e in of_b}
    sides = []
    for found in (of_a, of_b):
        groups = [[]]
        for i, _, e in found:
            groups[-1].append(str(i))
            if e in ends:
                groups.append([])
        sides.append([",".join(g) for g in groups[:-1]])
    return [f"{a}|{b}" for a, b in zip(*sides, strict=True)]


def rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("name", ["small", "edge", "empty"])
def test_equals_brute_force(spark, tokenizers, name, edge_folder, empty_folder):
    if name == "small" and not os.path.isdir(SMALL):
        pytest.skip("test tables not present")
    folder = {"small": SMALL, "edge": edge_folder, "empty": empty_folder}[name]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows(catalog.queries()["op13_align"](spark, folder)) == Counter(brute(tokenizers, docs))


@pytest.mark.parametrize("frequent", [0, 7, 10**6])
def test_hard_texts_with_any_size_of_the_sent_table(spark, tokenizers, frequent):
    docs = spark.createDataFrame(HARD, "doc_id long, text string")
    assert rows(alignment.alignment(docs, frequent=frequent)) == Counter(brute(tokenizers, HARD))


def test_groups_as_text(spark, tokenizers):
    docs = spark.createDataFrame([(1, "the harbour was quiet"), (2, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in alignment.align(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_groups=True).collect()}
    own = found[1]["groups"]
    assert hashlib.sha256(own.encode()).hexdigest() == found[1]["groups_sha256"] and own.count(";") == found[1]["n_groups"] - 1
    assert sum(found[1]["times"]) == found[1]["n_links"] and found[2]["groups"] == ""


def test_ranked_encoder_gives_the_vocabulary_own_ids(tokenizers):
    encode, _ = alignment.byte_level(public_tokenizers.path("byte_bpe_50k.json"))
    letters = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3000, 0x20000, 37) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}1{c} {c}{c}  {c}\n{c}'s" for c in letters]
    for text, want in zip(texts, tokenizers[0].encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == want.ids, repr(text)
