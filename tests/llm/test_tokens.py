import pyarrow as pa
import pytest

from casebook.llm.tokens import ByteTokenizer, WordTokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_words_give_the_ids_of_the_whole_text():
    tokenizer = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [
        "The cat, THE CAT. don't Don'T it's, 5. 5,000 a-b. (x)! ... é. É, Été!", "<|endoftext|>. <|ENDOFTEXT|>, a<|startoftext|>b",
        "tab\tnew\nline\r\x0b\x0c end", "nbsp sep   x \x1c y", "Å Å i̇ İ ß ẞ ſ K", "", " ", "日本語、テスト。 한국어.",
        "x" * 5000 + ".", "!!!, ?.? a.b.c. a1. 1a,",
    ]
    want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        got = tokenizer.encode(pa.array(texts))
        assert [[int.from_bytes(g[i : i + 4], "little") for i in range(0, len(g), 4)] for g in got] == want


def test_small_cache_gives_the_same():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array(["one two, three", "three Four. five", "six one two"])
    assert WordTokenizer(path, cache_words=2).encode(texts) == WordTokenizer(path).encode(texts)
    fine = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert ByteTokenizer(fine, cache_words=1).encode_words([b"one", b"two"]) == ByteTokenizer(fine).encode_words([b"one", b"two"])


def test_letter_words_have_the_ids_of_the_vocabulary():
    import random

    draw = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEÀÉÎŒœßñçüöäïŁž.,'!5ªµ"
    words = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 16))) for _ in range(30_000)]
    tokenizer = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert tokenizer.letters is not None
    want = tokenizer.tokenizer.encode_batch_fast(words, add_special_tokens=False)
    for word, ids, whole in zip(words, tokenizer.encode_bytes([w.encode() for w in words]), want, strict=True):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == whole.ids, word
