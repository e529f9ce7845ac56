"""Keys inside longer runs, and what the rules leave of a run."""

import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspar.llm import secrets

MODEL = secrets.RatioModel(secrets.samples())
ALPHABET = string.ascii_letters + string.digits


def key(rng, n):
    return "".join(rng.choices(ALPHABET, k=n))


def covered(text, start, end):
    base = secrets.base_spans(text)
    return sum(max(0, min(e, end) - max(s, start)) for s, _, e in base + secrets.model_spans(text, MODEL, base))


def best_first(steps, at=0):
    """The definition: the best segment (of equals the shortest, then the first), then the same on either side."""
    sums = [(-sum(steps[a:b]), b - a, a) for a in range(len(steps)) for b in range(a + 1, len(steps) + 1)]
    if not sums or min(sums)[0] >= 0:
        return []
    _, n, a = min(sums)
    return best_first(steps[:a], at) + [(at + a, at + a + n)] + best_first(steps[a + n :], at + a + n)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=24))
def test_segments_against_the_definition(steps):
    # Powers of two below one part equal sums, so that no two segments tie.
    steps = [x + 2.0 ** -(k + 1) for k, x in enumerate(steps)]
    assert secrets.segments(steps) == best_first(steps)


@pytest.mark.parametrize("n", [24, 32, 40, 64])
@pytest.mark.parametrize("before", [20, 40, 100])
def test_keys_in_paths_and_names(n, before):
    rng, found = random.Random(n * before), 0
    for k in range(100):
        words = []
        while sum(map(len, words)) + len(words) < before:
            words.append(rng.choice(secrets.WORDS))
        head = "/" + "/".join(words) + "/" if k % 2 else "_".join(words).upper() + "="
        found += covered(head + key(rng, n) + ("/" + "/".join(words) if k % 4 > 1 else ""), len(head), len(head) + n) >= 0.8 * n
    assert found >= 90


def test_two_keys_in_one_run_are_two_spans():
    rng = random.Random(3)
    path = "/some/quite/ordinary/service/path/with/words/in/"
    one, two = key(rng, 40), key(rng, 40)
    assert len(secrets.model_spans(path * 2 + one + path * 3 + two + path * 2, MODEL, [])) == 2


def test_what_a_rule_leaves_of_a_run_is_scored():
    rng = random.Random(4)
    for _ in range(20):
        text = "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)) + "_" + key(rng, 40)
        base = secrets.base_spans(text)
        assert [k for _, k, _ in base] == [1]
        (span,) = secrets.model_spans(text, MODEL, base)
        assert span[0] >= base[0][2] and span[2] - span[0] >= 32


def test_ordinary_runs_have_no_segments():
    assert [s for s, y in secrets.samples(11) if not y and secrets.model_spans(s, MODEL, [])] == []
    long = "/".join(random.Random(5).choices(secrets.WORDS, k=20_000))
    assert secrets.model_spans(long, MODEL, []) == []
