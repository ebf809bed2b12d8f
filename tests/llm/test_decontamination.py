"""Benchmark passages: both joins, planted passages, spans."""

import random
import re

from pyspark.sql import functions as F

from casebook.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size):
    """(doc, n_words, n_hit, items) by trying every window at every place."""
    windows = {}
    for item, text in items:
        own = words(text)
        for k in range(max(0, len(own) - size) + 1) if own else ():
            windows.setdefault(tuple(own[k : k + size]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if (holders := windows.get(tuple(own[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= holders
        out.append((doc, len(own), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return sorted(out)


def random_case(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "c", "Dé", "7"]
    text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(3, text(4)), (None, "a b c")]
    docs = [(i, text(rng.choice([0, 1, 3, 20, 60]))) for i in range(40)]
    docs += [(90, None), (91, items[0][1]), (92, "a " * 300)]
    return docs, items


def rows(df):
    return sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in df.collect())


def test_either_join_equals_brute_force(spark):
    for seed, (window, shingle, room) in enumerate([(5, 2, 10**6), (5, 2, 0), (4, 3, 0), (6, 5, 10**6)]):
        docs, items = random_case(seed)
        got = decontamination.contamination(
            spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
            window=window, shingle=shingle, broadcast_rows=room)
        assert rows(got) == brute(docs, items, window)


def test_spans_stand_where_the_passage_was_planted(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(1, f"x y {passage} z"), (2, " ".join(f"p{i}" for i in range(9))), (3, passage.upper().replace(" ", " -- "))]
    got = decontamination.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, passage)], "item_id long, text string"))
    found = {r["doc_id"]: r for r in got.collect()}
    assert [(s["start"], s["size"]) for s in found[1]["spans"]] == [(2 + k, 10) for k in range(5)]
    assert (found[1]["n_hit"], found[3]["n_hit"], found[2]["n_hit"]) == (14, 14, 0)
    assert found[2]["spans"] == [] and found[3]["item_ids"] == ["7"]


def test_only_windows_held_whole_are_joined(spark):
    """A window with one shingle that no document holds has no prefix."""
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d"), (2, "a b c x")], "item_id long, text string")
    own = decontamination.with_words(docs, "doc_id", "t-words")
    windows, _ = decontamination.windows_of(decontamination.with_words(items, "item_id", "t-items"), 4)
    of_windows = decontamination.window_shingles(windows, 2)
    counts = decontamination.shingle_counts(own, of_windows.select("shingle").distinct(), [2], True)
    kept = decontamination.rarest(of_windows, counts)
    assert kept.join(windows, "window_id").select(F.array_join("words", " ")).collect()[0][0] == "a b c d" and kept.count() == 1


def test_no_python_in_the_plan(spark, edge_folder):
    from casebook.llm import catalog

    plan = catalog.queries()["op11_decontaminate"](spark, edge_folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
