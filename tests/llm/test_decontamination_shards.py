"""Decontamination in shards gives what one automaton gives; items without an id count."""

import random

import pytest

from boardlake.llm import decontamination


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(100_000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def case(spark):
    """Passages that overlap, items that cover a document only together, and cuts that join words to another item."""
    long = words(60, 1)
    items = [(i, " ".join(long[a : a + 20])) for i, a in enumerate(range(0, 41, 8))]
    a, b, c = words(20, 2), words(20, 3), words(20, 4)
    items += [(20, " ".join(a)), (21, " ".join(b)), (22, " ".join(c)), (23, " ".join(words(6, 5) + words(6, 6)))]
    docs = [(1, words(90, 10) + long + words(90, 11)), (2, words(12, 12) + a + words(10, 13) + b + words(10, 14)), (3, words(50, 15)), (4, words(40, 5)[:6] + a + words(6, 6) + words(60, 16))]
    df = spark.createDataFrame([(i, " ".join(w), 0) for i, w in docs], "doc_id bigint, text string, n_chars bigint")
    return df, spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("most_words", [100, 30])
def test_removal_in_shards_is_that_of_one_automaton(case, most_words):
    df, bench = case
    rows = lambda n: sorted(tuple(r) for r in decontamination.remove_contamination(df, bench, most_words=n).collect())
    one = rows(10**6)
    assert {r[0] for r in one} == {1, 3, 4} and rows(most_words) == one
    found = lambda n: sorted((r.doc_id, r.n_words, str(r.hits), str(r.spans), r["items"]) for r in decontamination.find_contamination(df, bench, most_words=n).collect())
    assert found(most_words) == found(10**6)


@pytest.mark.parametrize("most_words", [10**6, 30])
def test_items_without_an_id_are_hit(spark, most_words):
    a, b = " ".join(words(20, 2)), " ".join(words(20, 3))
    bench = spark.createDataFrame([(None, a), (None, b), (5, b)], "item_id bigint, text string")
    tail = " ".join(words(60, 9))
    df = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, tail)], "doc_id bigint, text string")
    got = {r.doc_id: r["items"] for r in decontamination.find_contamination(df, bench, most_words=most_words).collect()}
    assert got == {1: [None], 2: ["5", None], 3: []}
    kept = {r.doc_id: r.text.strip() for r in decontamination.remove_contamination(df, bench, most_words=most_words).collect()}
    assert kept == {1: tail, 2: tail, 3: tail}
