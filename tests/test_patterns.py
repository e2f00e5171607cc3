import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from letterloom.functions.patterns import read_pattern


@pytest.mark.parametrize(
    "pattern, runs",
    [
        ("abc", ["^abc$"]), ("ab?c", ["^a", "c$"]), ("ab+c", ["^ab", "c$"]), ("a.c", ["^a", "c$"]), ("th(e|a)n?", ["^th", "$"]),
        ("a|b", []), ("(ab)c", ["^", "c$"]), ("[ab]cd[ef]g", ["^", "cd", "g$"]), ("ab{0,2}c", ["^a", "c$"]), ("ab{2}c", ["^ab", "c$"]),
        ("^ab$", ["^ab$"]), ("\\dab", ["^", "ab$"]), ("a+?b", ["^a", "b$"]), ("", ["^$"]), ("a\\$", ["^a", "$"]),
    ],
)
def test_literal_runs(pattern, runs):
    assert read_pattern(pattern) == (None, runs)


@settings(max_examples=300, deadline=None)
@given(st.text("ab.*+?()[]|{},12^$\\d-", max_size=8), st.text("ab12", min_size=1, max_size=5))
def test_taken_patterns_are_expressions_and_matches_hold_their_runs(pattern, word):
    reason, runs = read_pattern(pattern)
    if reason is None:
        # possessive and lazy quantifiers, classes and counts read alike
        if re.fullmatch(f"(?:{pattern})", word):
            assert all(run in f"^{word}$" for run in runs)
