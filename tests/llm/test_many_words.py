"""Buckets whose recurring phrases hold very many distinct words."""

import numpy as np
import pytest

from scholargraph.llm import substring


@pytest.mark.parametrize("n", [64, 5000, 60_000, 1_500_000])
def test_many_distinct_words(n):
    text = " ".join(map(str, range(n)))
    row = substring.Texts([text, None, "x " + text])
    every = np.arange(0, n - substring.PHRASE + 1, substring.PHRASE)
    automaton = substring.Automaton([b" ".join(row.words[a : a + substring.PHRASE]) for a in every.tolist()])
    assert np.array_equal(automaton.places(row), np.concatenate([every, every + n + 1]))


def test_two_copies_of_a_word_list(spark):
    text = " ".join(map(str, range(60_000)))
    out = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 60_000}


def test_hits_decide():
    """No phrase is found over the end of a text, nor by anything but its words."""
    a = [f"w{i}" for i in range(30)]
    row = substring.Texts([" ".join(a[:15]), " ".join(a[15:]), " ".join(a[5:20]).replace("w12", "w12x")])
    phrases = [" ".join(a[i : i + substring.PHRASE]).encode() for i in range(20)]
    assert substring.Automaton(phrases).places(row).tolist() == [*range(0, 6), *range(15, 20)]
    assert substring.Automaton([]).places(row).tolist() == []
