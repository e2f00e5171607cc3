"""Operators over documents against brute force on small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from letterloom.llm import decontaminate, language, mixture, simhash, tokens
from letterloom.llm.components import components
from letterloom.llm.oracle import CONTAMINATION
from letterloom.llm.wavelet import WaveletMatrix
from tests.llm.data import AWKWARD, SF, clashing, documents, sample

# --- near duplicates -------------------------------------------------------------------------


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            root[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)].append(key)
    return [(key, f"{prints[i]:016x}", min(least[top(i)], default=None)) for i, (key, _) in enumerate(rows)]


def near_copies():
    base = [f"w{i * 7919 % 1000}" for i in range(400)]
    rows = [(1000 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]), "en", "a") for i in range(60)]
    return rows + [(2000 + i, " ".join(base[: 390 + i]), "en", "b") for i in range(10)]


def test_near_duplicates(spark):
    rows = AWKWARD + near_copies()
    docs = clashing(documents(spark, rows)).unionByName(clashing(sample(spark, 60)), allowMissingColumns=True)
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_components(plain), key=repr)
    assert simhash.near_duplicates(documents(spark)).count() == 0


@pytest.mark.parametrize("together", [16, 64, 4096])
def test_no_link_is_lost_when_keys_are_cut(spark, together):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    prints = {centre}
    for _ in range(400):  # a dense cloud, with members near each other and far
        prints.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    prints |= {int(x) for x in rng.integers(0, 2**63, 100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = components(simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint").repartition(3), max_together=together)).collect()
    have = defaultdict(set)
    for node, root in found:
        have[root].add(node)
    root = {p: p for p in signed}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            root[top(a)] = top(b)
    want = defaultdict(set)
    for p in signed:
        want[top(p)].add(p)
    assert sorted(sorted(g) for g in have.values()) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_one_of_each(spark):
    docs = documents(spark, AWKWARD + near_copies())
    kept = simhash.one_of_each(docs).collect()
    groups = {c for _, _, c in plain_components([(i, t) for i, t, *_ in AWKWARD + near_copies()])}
    assert set(kept[0].asDict()) == set(docs.columns)
    assert sorted(r["doc_id"] for r in kept) == sorted([*groups, 9])  # two groups have a row with key 9


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 560)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- tokens ----------------------------------------------------------------------------------

ODD_TEXTS = ["Hello world", " a b", "a  b", "x\n\ny", "x\ny z", "", "é ü tr", "tail ", "\nstart", "it's don't\tx", "<|endoftext|> hi", "a\x00b", "x  　y", "日本 語\n🎉 a", " ", "\n"]


def test_pieces_give_the_ids_of_whole_texts(spark):
    texts = ODD_TEXTS + [r["text"] for r in sample(spark).select("text").collect()]
    coder = tokens.PieceEncoder(tokens.VOCABULARY)
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, coder.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 50, n).astype(np.uint16)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.of(ids, 6).to_bytes())
    assert matrix.ids(np.uint16).tolist() == ids.tolist()
    assert [matrix.count(t) for t in range(64)] == [int((ids == t).sum()) for t in range(64)]
    for i in range(0, n, max(1, n // 25)):
        token = int(ids[i])
        assert matrix.access(i) == token
        nth = matrix.rank(token, i)
        assert nth == int((ids[:i] == token).sum()) and matrix.select(token, nth) == i
    with pytest.raises(IndexError):
        matrix.select(63, 0)


@pytest.mark.parametrize("shard_tokens", [50, 1 << 18])
def test_shards_give_back_every_document(spark, shard_tokens):
    rows = AWKWARD + [(50 + i, t, "en", "a") for i, t in enumerate(ODD_TEXTS)]
    shards = tokens.token_shards(clashing(documents(spark, rows).drop("key", "row")), shard_tokens=shard_tokens)
    got = tokens.read_documents(shards).orderBy("start").collect()
    coder = tokens.PieceEncoder(tokens.VOCABULARY)
    want = Counter()
    for key, text, *_ in rows:
        ids = coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want[key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    keys = [-1 if r[0] is None else r[0] for r in got]
    assert keys == sorted(keys)
    assert tokens.encode_documents(documents(spark)).count() == 0


# --- decontamination -------------------------------------------------------------------------


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split(" ")


def plain_contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = [w for w in plain_words(text) if w]
        n = min(10, len(words))
        for i in range(len(words) - n + 1) if words else []:
            windows[tuple(words[i : i + n])].add(str(item))
    out = []
    for key, text, *_ in rows:
        words = [w for w in plain_words(text) if w]
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if of := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= of
        out.append((key, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
BENCHMARK = [(1, PASSAGE), (2, PASSAGE), (10, "Short ITEM here"), (3, None), (4, ""), (5, "..."), (6, "日本語 ÄÖ"), (7, "two three four five six seven eight nine ten eleven")]
CONTAMINATED = AWKWARD + [
    (60, f"x {PASSAGE.upper()}, y", "en", "a"),
    (61, f"{PASSAGE} {PASSAGE}", "en", "a"),
    (62, "a short, item? HERE!", "en", "a"),
    (63, "one two three four five six seven eight nine", "en", "a"),
    (64, "ÄÖ 日本語 ÄÖ 日本語 äö", "en", "a"),
]


@pytest.mark.parametrize("sent", [0, 50_000])
def test_contamination(spark, sent):
    got = decontaminate.contamination(clashing(documents(spark, CONTAMINATED).drop("key", "row")), benchmark(spark, BENCHMARK), sent_windows=sent)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_contamination(CONTAMINATED, BENCHMARK), key=repr)


def test_contamination_of_empty_tables(spark):
    assert decontaminate.contamination(documents(spark), benchmark(spark, BENCHMARK)).count() == 0
    got = decontaminate.contamination(documents(spark, AWKWARD), benchmark(spark, [])).collect()
    assert len(got) == len(AWKWARD) and not any(r["contaminated"] for r in got)


def test_decontaminated(spark):
    docs, items = documents(spark, CONTAMINATED), benchmark(spark, BENCHMARK)
    clean = decontaminate.decontaminated(docs, items)
    dirty = {r[0] for r in plain_contamination(CONTAMINATED, BENCHMARK) if r[5]}
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, *_ in CONTAMINATED if i not in dirty)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs, items, remove="spans").collect()}
    assert cut[60] == "x y" and cut[61] == "" and cut[63] == "one two three four five six seven eight nine"
    assert not any(r[5] for r in plain_contamination([(k, t) for k, t in cut.items()], BENCHMARK))


def test_contamination_sql_is_registered():
    assert "windows" in CONTAMINATION


# --- mixture ---------------------------------------------------------------------------------


def plain_targets(sizes):
    """The rule as it is told: share by weight, cap, share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, targets, capped = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weights[s] for s in names if s not in capped)
        targets = {s: float(3 * sizes[s]) if s in capped else rest * weights[s] / free for s in names}
        over = {s for s in names if s not in capped and targets[s] > 3 * sizes[s]}
        if not over:
            return targets
        capped |= over


@pytest.mark.parametrize("big", [False, True])
def test_mixture(spark, big):
    rows = AWKWARD + [(100 + i, "w " * (i % 37), "en", ["a", "b", "c", None, "tiny", "é"][i % 7 % 6]) for i in range(400)]
    docs = clashing(documents(spark, rows).drop("key", "row")) if not big else spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.select("doc_id", "text", "source").collect()
    count = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, text, source in plain:
        sizes[source] += count(text)
    got = mixture.mixture_report(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, count(t), sizes[s]) for i, t, s in plain)
    targets = plain_targets(sizes)
    of_source = {}
    for r in mixture.source_targets(docs.select("source", mixture.word_count(F.col("text")).alias("size"))).collect():
        of_source[r["source"]] = r["target"]
    assert of_source == pytest.approx(targets)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken = defaultdict(int)
    for r in mixture.mixture(docs).select("source", "taken").collect():
        taken[r["source"]] += r["taken"]
    for source, words in taken.items():
        assert abs(words - targets[source]) <= 3 * mixture.BLOCK_WORDS
    assert sorted(got, key=repr) == sorted(mixture.mixture_report(docs.repartition(7)).collect(), key=repr)
    assert mixture.mixture_report(documents(spark)).count() == 0


def plain_apportionment(targets, seats):
    won = dict.fromkeys(targets, 0)
    for _ in range(seats):
        best = max(sorted(targets), key=lambda s: targets[s] / (2 * won[s] + 1))
        won[best] += 1
    return won


def test_quotas_are_highest_quotients(spark):
    targets = {1: 700.0, 2: 333.0, 3: 100.0, 4: 66.0, 5: 0.0, 6: 1.0}
    table = spark.createDataFrame(list(targets.items()), "sid int, target double")
    got = defaultdict(int)
    for sid, shard, quota in mixture.shard_quotas(table, block_words=10, shards=4).collect():
        got[sid] += quota
        assert quota >= 0 and 0 <= shard < 4
    assert dict(got) == {s: n for s, n in plain_apportionment(targets, 120).items() if targets[s]}


def test_mixed_holds_what_was_taken(spark):
    rows = [(i, f"  {i} " + " ".join(f"w{j}" for j in range(i % 300)) + "\n", "en", "ab"[i % 2]) for i in range(300)] + AWKWARD
    docs = documents(spark, rows)
    out = mixture.mixed(docs)
    assert out.columns == docs.columns
    count = lambda t: len((t or "").encode().split())
    have = Counter()
    for r in out.collect():
        have[r["doc_id"]] += count(r["text"])
        assert r["n_chars"] == len(r["text"])
    want = Counter()
    for r in mixture.mixture_report(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert +have == +want


# --- language --------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language.language_report(docs).collect()
    assert len(got) == len(labels)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    texts = (("the cat and the hat sat", "en"), ("der Hund und die Katze", "de"))
    rows = AWKWARD + [(200 + 2 * i + k, t, lang, "a") for i in range(40) for k, (t, lang) in enumerate(texts)]
    got = language.language_report(clashing(documents(spark, rows).drop("key", "row"))).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 7):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[200]["lang_pred"] == "en" and by_id[201]["lang_pred"] == "de" and by_id[6]["lang_pred"] in ("en", "de")
    assert {r["lang_pred"] for r in language.language_report(documents(spark, [(1, "some text", None, None)])).collect()} == {"und"}
    assert language.language_report(documents(spark)).count() == 0


def test_filters_return_all_languages_of_an_ngram():
    rng = np.random.default_rng(3)
    grams = {i: rng.integers(0, 2**63, 3000).astype(np.uint64) for i in range(11)}
    slots = np.zeros((1 << language.SLOT_BITS, 2), np.uint8)
    for i, own in grams.items():
        for slot in language.slots_of(own, language.SLOT_BITS, language.HASHES):
            slots[slot, i // 8] |= np.uint8(1 << i % 8)
    filters = language.LanguageFilters([f"l{i:02}" for i in range(11)], slots)
    for i, own in grams.items():
        bits = np.unpackbits(filters.masks(own), axis=1, bitorder="little")[:, :11]
        assert bits[:, i].all() and bits.sum(1).mean() < 1.1


def test_long_texts_lose_no_ngram(monkeypatch):
    letters = language.letters_of("the quick brown fox jumps over the lazy dog " * 20)
    whole = np.sort(language.ngram_hashes(letters))
    monkeypatch.setattr(language, "_WINDOW", 37)
    assert np.sort(np.concatenate(list(language._parts(letters)))).tolist() == whole.tolist()


# --- the pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixing", "token_shards"]
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    one = stages["language"](spark, docs, SF).cache()
    assert one.columns == docs.columns and one.count() >= 0.97 * docs.count()
    two = stages["near_duplicates"](spark, one, SF).cache()
    plain = [(r["doc_id"], r["text"]) for r in one.select("doc_id", "text").collect()]
    assert ids(two) == sorted({c for _, _, c in plain_components(plain)})
    three = stages["decontamination"](spark, two, SF).cache()
    dirty = {r[0] for r in plain_contamination([(r["doc_id"], r["text"]) for r in two.collect()], items) if r[5]}
    assert dirty and ids(three) == [i for i in ids(two) if i not in dirty]
    four = stages["mixing"](spark, three, SF).cache()
    assert four.columns == docs.columns and four.count() > 0
    five = stages["token_shards"](spark, four, SF).orderBy("start").collect()
    coder = tokens.PieceEncoder(tokens.VOCABULARY)
    want = Counter((r["doc_id"], len(coder.tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in four.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in five) == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark, []).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# --- near duplicates of the pipeline ---------------------------------------------------------


def test_one_of_each_keeps_one_row_of_every_linked_group(spark):
    rng = np.random.default_rng(9)
    rows = [(i, r["text"]) for i, r in enumerate(sample(spark).select("text").collect())]
    base = [f"w{i}" for i in range(400)]
    for i in range(60):  # one cloud of copies around the distance
        words = list(base)
        for at in rng.choice(400, i % 4, replace=False):
            words[at] = f"x{i}"
        rows.append((5000 + i, " ".join(words)))
    rows += [(7000, "a b c"), (7001, "A  b c"), (7002, "a b d"), (7003, None), (7004, " ")]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted(r["doc_id"] for r in simhash.one_of_each(clashing(docs)).collect())
    assert got == sorted({c for _, _, c in plain_components(rows)})
    assert sum(i >= 5000 for i in got) < 40


def test_one_of_each_takes_awkward_rows(spark):
    kept = simhash.one_of_each(clashing(documents(spark, AWKWARD)))
    assert kept.columns == clashing(documents(spark, AWKWARD)).columns
    found = sorted((r["doc_id"], r["text"][:20] if r["text"] else "") for r in kept.collect())
    # one text without words, one of the three equal ones (the row without a key gives way), and the others
    assert [f for f in found if f[0] != 9] == [(1, ""), (4, "the same words in a "), (6, "short"), (7, "1234567890 %%% $$$"), (8, "ÄÖÜ straße ſecret K ")]
    assert sum(f[0] == 9 for f in found) == 2
    assert simhash.one_of_each(documents(spark)).collect() == []
