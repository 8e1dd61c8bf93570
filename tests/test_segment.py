"""Reference segmentation against a plain search over all runs of labels."""

import itertools
import random

import pytest

from scholargraph.functions import segment as S


def best_run(numbers):
    """(length, numbers left out) of the best run among all subsets."""
    best = (0, 0)
    for size in range(1, len(numbers) + 1):
        for at in itertools.combinations(range(len(numbers)), size):
            run = [numbers[i] for i in at]
            if all(1 <= b - a <= 10 for a, b in zip(run, run[1:])):
                best = max(best, (size, run[0] - run[-1] + size - 1))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_longest_run(seed):
    rng = random.Random(seed)
    numbers = [rng.randrange(1, 14) for _ in range(rng.randrange(1, 11))]
    got = [numbers[i] for i in S.ordinal_chain(numbers)]
    length, left_out = best_run(numbers)
    steps = [b - a for a, b in zip(got, got[1:])]
    if got:
        assert len(got) == length >= 3 and got[0] - got[-1] + len(got) - 1 == left_out and all(1 <= s <= 10 for s in steps)
        assert steps.count(1) >= max(2, int(0.7 * len(steps)))
    elif length >= 3:
        assert left_out < 0  # some labels are left out, so too few follow on at once


def test_runs_that_count():
    assert S.ordinal_chain([1, 2, 3]) == [0, 1, 2] and S.ordinal_chain([1, 2]) == [] and S.ordinal_chain([]) == []
    assert S.ordinal_chain([1, 7, 2, 3, 30, 4]) == [0, 2, 3, 5]
    assert S.ordinal_chain([1, 3, 5, 7, 9]) == []  # too few follow on at once
    assert S.ordinal_chain([5, 6, 7, 1, 2, 3]) == [3, 4, 5]  # of two like runs the one of smaller numbers
    assert len(S.ordinal_chain(list(range(1, 5001)))) == 5000


def test_styles():
    lines = [f"[{i}] A. Author, J. Test {i}" for i in range(1, 6)]
    entries, method, sure = S.segment("\r\n".join(lines) + "\r\n  continued")
    assert [n for n, _ in entries] == [1, 2, 3, 4, 5] and entries[-1][1] == "A. Author, J. Test 5 continued" and (method, sure) == ("numbered-punctuated", "HIGH")
    assert S.segment("\n".join(f"({i}) entry {i}" for i in range(8, 13)))[1] == "numbered-parenthesized"
    assert S.segment("\n".join(f"{i} Entry" for i in range(1, 5)))[1] == "numbered-bare"
    assert S.segment("\n".join(f"{i}. entry" for i in range(8, 13)))[1:] == ("raw-unsegmented", "LOW")  # begins too late
    assert S.segment("Lee 1999. Kim 2001. Ito 2010.")[1:] == ("raw-author-year-or-unsegmented", "MEDIUM")
    assert S.segment("2001. a\n2002. b\n2003. c")[0] == [] and S.segment(None)[1] == "raw-unsegmented" and S.segment("[1]\n[2]\n[3]")[0] == []
