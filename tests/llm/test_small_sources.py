"""Sources of a few words in the mix."""

from collections import Counter

import pytest

from letterloom.llm import mixture
from tests.llm.data import documents
from tests.llm.test_documents import plain_targets

TAIL = {None: 10, "t1": 1, "t2": 5, "t3": 10, "t4": 20, "t5": 31, "t6": 65, "t7": 100, "t8": 200}


@pytest.mark.parametrize("sizes", [TAIL | {"big": 30_000, "large": 20_000}, {"a": 20, "b": 20}, {"a": 5, "b": 200, "c": 65}, {f"s{i:03}": 5 + i for i in range(190)}])
def test_small_sources_meet_their_targets(spark, sizes):
    rows = []
    for source, n in sizes.items():
        for at in range(0, n, 50):
            rows.append((len(rows), " ".join(f"w{j}" for j in range(min(50, n - at))), "en", source))
    docs = documents(spark, rows)
    targets, taken, held = plain_targets(sizes), Counter(), Counter()
    for r in mixture.mixture(docs).select("source", "taken").collect():
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        if target == 3 * sizes[source]:
            assert taken[source] == target
        else:  # words are whole
            assert abs(taken[source] - target) <= max(2, 0.04 * target), (source, target)
    for r in mixture.mixed(docs).collect():
        held[r["source"]] += len(r["text"].split())
    assert +held == +taken
