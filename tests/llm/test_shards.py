"""Lookups in written shards against the plain sequence of ids."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from letterloom.llm import shards, tokens, wavelet
from letterloom.session import written
from tests.llm.data import AWKWARD, documents, sample


def plain(rows):
    """All ids in order, with the key and place of each; rows must have distinct keys."""
    coder = tokens.PieceEncoder(tokens.VOCABULARY)
    out = []
    for key, text in sorted(rows):
        out += [(int(i), key, at) for at, i in enumerate([*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID])]
    return out


@pytest.mark.parametrize("shard_tokens", [300, 1 << 18])
def test_lookups(spark, shard_tokens):
    rows = [(r["doc_id"], r["text"]) for r in sample(spark, 40).collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "x " * 3000)]
    held = written(tokens.token_shards(documents(spark, [(k, t, "en", "a") for k, t in rows]), shard_tokens=shard_tokens), "shards")
    want = plain(rows)
    n = len(want)
    asked = [0, 1, 1, n - 1, n, -1, None, *range(7, n, 97)]
    got = shards.tokens_at(held, spark.createDataFrame([(i,) for i in asked], "place bigint"), cell=500).collect()
    assert Counter(map(tuple, got)) == Counter((i, want[i][0] if i is not None and 0 <= i < n else None) for i in asked)
    counts = Counter(i for i, _, _ in want)
    common = [i for i, _ in counts.most_common(3)]
    rare = [i for i, c in counts.items() if c == 1][:5]
    ids = [*common, *rare, rare[0], tokens.END_ID, 1 << 16, -1]
    assert {r["token"]: r["count"] for r in shards.token_counts(held, ids).collect()} == {i: counts[i] for i in ids}
    found = sorted(map(tuple, shards.occurrences(held, ids).collect()))
    assert found == sorted((i, place, key, at) for place, (i, key, at) in enumerate(want) if i in set(ids))


def test_lookups_in_awkward_and_no_shards(spark):
    held = written(tokens.token_shards(documents(spark, AWKWARD), shard_tokens=50), "shards")
    ends = shards.occurrences(held, [tokens.END_ID], key="k")
    assert ends.count() == len(AWKWARD) and Counter(r["k"] for r in ends.collect()) == Counter(r[0] for r in AWKWARD)
    none = written(tokens.token_shards(documents(spark)), "shards")
    assert [tuple(r) for r in shards.token_counts(none, [2, 5]).orderBy("token").collect()] == [(2, 0), (5, 0)]
    assert shards.token_counts(held, []).count() == 0 and shards.occurrences(none, [2]).count() == 0
    assert [tuple(r) for r in shards.tokens_at(none, spark.createDataFrame([(0,)], "place bigint")).collect()] == [(0, None)]


@pytest.mark.parametrize("few", [0, 1000])
def test_occurrences_one_by_one_and_by_planes(few, monkeypatch):
    monkeypatch.setattr(wavelet, "FEW", few)
    ids = np.random.default_rng(3).integers(0, 40, 3000).astype(np.uint16)
    matrix = wavelet.WaveletMatrix.of(ids, 6)
    for token in (0, 7, 39, 40, 63, 64, -1):
        assert matrix.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()


def test_what_a_full_memory_keeps(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 3)
    coder = tokens.PieceEncoder(tokens.VOCABULARY)
    texts = ["one two three", "two four five", "", "two  six", "seven two,\nfour"]
    for _ in range(2):
        for text in texts:
            ids = coder.encode(pa.array([text]))[0]
            assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


ENDS = ["dog. dog, dog dog!? (dog) dog.%%% dog's.", "it's, 'll. 12.5. 3,", ". ,.. ... .a ., x", "école. Straße, ×. ÷, ª² ①. e\u0301. 日. ß", "\ndog.\ndog\n.\n", "dog.\u200b dog\u200b.", "a<|endoftext|>. b.<|endoftext|>, <|endoftext.|>", "", "."]


def test_a_word_is_known_once_whatever_signs_end_it():
    coder = tokens.PieceEncoder(tokens.VOCABULARY)
    for _ in range(2):
        for text, ids in zip(ENDS, coder.encode(pa.array(ENDS)), strict=True):
            assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert not {" dog,", " dog!?", " dog.%%%", "\ndog."} & set(coder.known) and " dog" in coder.known


@pytest.mark.parametrize("splits", [True, False])
def test_signs_that_a_vocabulary_joins_stay_with_their_word(tmp_path, splits):
    fixed = Tokenizer.from_file(tokens.VOCABULARY)
    if splits:
        fixed.add_special_tokens(["<dog.>", "dog,"])
    else:
        fixed.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.Split("\n", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    fixed.save(path := str(tmp_path / "own.json"))
    coder = tokens.PieceEncoder(path)
    assert set(tokens.END_SIGNS) - set(coder.end_signs) == ({".", ","} if splits else set(tokens.END_SIGNS))
    texts = [*ENDS[:3], "a <dog.> dog, dog. b", "the <dog.>, dog,."]
    for text, ids in zip(texts, coder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
