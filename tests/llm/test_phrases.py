import random
import re
from collections import Counter, defaultdict

import pytest

from letterloom.llm.phrases import top_phrases
from tests.llm.data import AWKWARD, clashing, documents, sample

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_phrases(rows, least=100, top=2000):
    """All phrases counted, all candidates scored and compared."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                inside.update(q for q in (p[i : i + m] for i in range(len(p) - m + 1)) if 100 * a >= 100 * candidates[q])
        found = []
        for p, a in candidates.items():
            if p not in inside:
                cuts = [(1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, least, top, first, widen", [(1, 3, 8, 1, 8), (3, 2, 1000, 4, 64)])
def test_top_phrases_is_plain(spark, seed, least, top, first, widen):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    fixed = ["Once upon a time there was one", "of the people, by the people", "a a a a a a a"]
    rows = []
    for i in range(300):
        words = r.choices(vocabulary, weights, k=r.randint(0, 30))
        if r.random() < 0.2:
            words.insert(r.randint(0, len(words)), r.choice(fixed))
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for w in words)
        rows.append((i, text, r.choice(["en", "en", "de", None, "und"]), "s"))
    df = documents(spark, rows).repartition(3)
    got = found(top_phrases(df, least=least, top=top, first=first, widen=widen))
    assert got == plain_phrases([(t, lang) for _, t, lang, _ in rows], least, top)
    assert len({lang for lang, *_ in got}) == 3


def test_awkward_rows(spark):
    df = clashing(documents(spark, AWKWARD))
    assert found(top_phrases(df, least=2)) == plain_phrases([(t, lang) for _, t, lang, _ in AWKWARD], 2)
    assert found(top_phrases(documents(spark))) == []
    assert found(top_phrases(documents(spark, [(1, None, None, None), (2, "", "en", "a")]))) == []


def test_one_long_text_and_odd_bytes(spark):
    long = "x y z " * 60_000 + "\0 ▁ ÄB é q; " * 150
    rows = [(1, long, "en", "a"), (2, "é q ÄB é q ab", "en", "a")]
    assert found(top_phrases(documents(spark, rows))) == plain_phrases([(t, lang) for _, t, lang, _ in rows])


def test_given_texts(spark):
    df = sample(spark)
    rows = [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]
    assert found(top_phrases(df, least=20, top=300)) == plain_phrases(rows, 20, 300)
