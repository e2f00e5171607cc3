"""Search against a brute-force scorer on a small corpus."""

import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from letterloom.operators import dictionary
from letterloom.operators import search as s
from letterloom.operators.dictionary import Dictionary
from letterloom.operators.expand import expand as expand_in
from letterloom.operators.expand import with_reasons
from letterloom.plans.index import refresh_index, write_index

VOCABULARY = ["the", "then", "than", "tha", "on", "no", "noon", "night", "nigth", "knight", "élan", "elan", "a", "ab", "abc", "abcd", "cab", "12"]


def corpus():
    rng = random.Random(11)
    docs = {i: [rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 30))] for i in range(60)}
    docs[60] = ["rare", "word", "on", "on", "no"]
    return docs


DOCS = corpus()


def index_over(spark, docs, root, **options):
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string")
    listing = rows.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit("x").alias("id"), F.lit(1).cast("bigint").alias("stamp"))
    texts = rows.select("doc_id", F.lit("body").alias("field"), F.array("text").alias("values"))
    return write_index(listing, texts, root, stop_words=(), **options)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return index_over(spark, DOCS, str(tmp_path_factory.mktemp("index")), rows_per_file=40)


def clauses(spark, rows):
    """rows: (query_id, clause_id, occur, kind, term, upper, slop, boost, times)"""
    schema = "query_id bigint, clause_id int, occur string, kind string, term string, upper string, slop int, boost double, times int"
    return s.as_clauses(spark.createDataFrame(rows, schema), field="body")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expand(kind, term, upper, slop):
    if kind == "prefix":
        test = lambda w: w.startswith(term)
    elif kind == "wildcard":
        pattern = re.escape(term).replace(r"\*", ".*").replace(r"\?", ".")
        test = lambda w: re.fullmatch(pattern, w)
    elif kind == "regexp":
        test = lambda w: re.fullmatch(term, w)
    elif kind == "fuzzy":
        test = lambda w: distance(w, term) <= slop
    else:
        test = lambda w: (term is None or w >= term) and (upper is None or w <= upper)
    return {w for words in DOCS.values() for w in words if test(w)}


def idf(word):
    return 1 + math.log(len(DOCS) / (sum(word in w for w in DOCS.values()) + 1))


def phrase_starts(doc, words, slop):
    """Positions of the first word with a choice of distinct positions, each within slop of its place."""
    places = [[p for p, w in enumerate(doc) if w == word] for word in words]
    out = set()
    for choice in itertools.product(*places):
        shifted = [p - i for i, p in enumerate(choice)]
        if len(set(choice)) == len(choice) and max(shifted) - min(shifted) <= slop:
            out.add(choice[0])
    return out


def weight(doc, kind, term, upper, slop, boost, times):
    factor = boost * times
    norm = math.sqrt(len(doc))
    if kind == "term":
        return factor * math.sqrt(doc.count(term)) * idf(term) ** 2 / norm if term in doc else None
    if kind == "phrase":
        words = term.split()
        found = len(phrase_starts(doc, words, slop))
        return factor * math.sqrt(found) * sum(map(idf, words)) ** 2 / norm if found else None
    words = expand(kind, term, upper, slop) & set(doc)
    if not words:
        return None
    if kind == "fuzzy":
        return sum(factor * math.sqrt(doc.count(w)) * idf(w) ** 2 / norm for w in words)
    return factor


def brute(rows, k):
    out = set()
    for query, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        group = list(group)
        scoring = sum(r[8] for r in group if r[2] != "must_not")
        scores = []
        for doc_id, doc in DOCS.items():
            got = [(r, weight(doc, r[3], r[4], r[5], r[6], r[7], r[8])) for r in group]
            if any(w is not None for r, w in got if r[2] == "must_not") or any(w is None for r, w in got if r[2] == "must"):
                continue
            hit = [(r, w) for r, w in got if w is not None and r[2] != "must_not"]
            if hit:
                scores.append((-round(sum(w for _, w in hit) * sum(r[8] for r, _ in hit) / scoring, 6), doc_id))
        out |= {(query, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:k], 1)}
    return out


def close(got, want):
    got = {(r.query_id, r["rank"], r.doc_id, r.score) for r in got.collect()}
    assert {g[:3] for g in got} == {w[:3] for w in want}
    scores = {w[:3]: w[3] for w in want}
    assert all(abs(g[3] - scores[g[:3]]) < 2e-6 for g in got)


def one(kind, term, upper=None, slop=0, query=1, clause=0, occur="should", boost=1.0, times=1):
    return (query, clause, occur, kind, term, upper, slop, boost, times)


def test_words_with_all_occurs(spark, index):
    rows = [
        one("term", "the", query=1), one("term", "night", query=1, clause=1, boost=2.0), one("term", "absent", query=1, clause=2),
        one("term", "the", query=2, occur="must"), one("term", "on", query=2, clause=1, occur="must"), one("term", "cab", query=2, clause=2),
        one("term", "the", query=3), one("term", "no", query=3, clause=1, occur="must_not"), one("term", "a", query=3, clause=2, times=3),
        one("term", "absent", query=4, occur="must"), one("term", "the", query=4, clause=1),
        one("term", "the", query=5, occur="must_not"),
        one("prefix", "ab", query=6, occur="must"), one("term", "on", query=6, clause=1, occur="must"), one("fuzzy", "night", slop=1, query=6, clause=2),
    ]
    for k in (3, 25):
        close(s.search(index, clauses(spark, rows), k), brute(rows, k))
    plain = [r for r in rows if r[0] == 1]
    close(s.search(index, clauses(spark, plain), kinds=("term",), occurs=("should",)), brute(plain, 25))


def test_patterns(spark, index):
    rows = [
        one("prefix", "th", query=1), one("prefix", "abcd", query=2), one("prefix", "", query=3),
        one("wildcard", "n*t", query=4), one("wildcard", "?b*", query=5), one("wildcard", "th?n", query=6), one("wildcard", "*", query=7),
        one("regexp", "th(e|a)n?", query=8), one("regexp", "no|on", query=9), one("regexp", "abc?d?", query=10), one("regexp", "[0-9]+", query=11),
        one("regexp", "é.*", query=16), one("wildcard", "a.c", query=17),
        one("range", "no", "the", query=12), one("range", None, "ab", query=13), one("range", "the", None, query=14), one("range", "nig", "nih", query=15),
    ]
    close(s.search(index, clauses(spark, rows), kinds=("prefix", "wildcard", "regexp", "range"), occurs=("should",)), brute(rows, 25))


def expanded(spark, index, rows):
    """The terms of each clause; its query's number names the pattern."""
    patterns = with_reasons(clauses(spark, rows)).withColumn("pattern", F.col("query_id"))
    return expand_in(patterns, Dictionary(index)).select(F.col("pattern").alias("query_id"), "term")


def test_fuzzy_expansion_is_exact(spark, index):
    """Every pair of vocabulary words and all short words, at each distance."""
    words = sorted({*VOCABULARY, "rare", "word", "x", "te", "hen", "nightly", "abdc", "bcda", "knigh", "eight"})
    rows = [one("fuzzy", w, slop=d, query=i * 3 + d) for i, w in enumerate(words) for d in (0, 1, 2)]
    found = expanded(spark, index, rows).collect()
    got = [(r.query_id, r.term) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == {(r[0], w) for r in rows for w in expand("fuzzy", r[4], None, r[6])}


def test_pattern_expansion_has_no_repeats(spark, index):
    rows = [one("prefix", "ab"), one("wildcard", "*b*", query=2)]
    got = [(r.query_id, r.term) for r in expanded(spark, index, rows).collect()]
    assert sorted(got) == sorted((r[0], w) for r in rows for w in expand(r[3], r[4], None, 0))


def test_phrases(spark, index):
    phrases = ["the then", "on no", "on on", "on on no", "rare word", "rare word on on no", "no such phrase", "a", "the a the", "night knight night", "on on on"]
    rows = [one("phrase", p, slop=n, query=q) for q, (p, n) in enumerate(itertools.product(phrases, (0, 1, 2, 3)))]
    close(s.search(index, clauses(spark, rows), kinds=("phrase",), occurs=("should",)), brute(rows, 25))
    hits = s.clause_hits(index, clauses(spark, rows), ("phrase",), ("should",)).select("query_id", "doc_id").collect()
    want = {(r[0], d) for r in rows for d, doc in DOCS.items() if phrase_starts(doc, r[4].split(), r[6])}
    assert {tuple(h) for h in hits} == want and len(hits) == len(want)


@pytest.mark.parametrize("one_in", [1, 3])
def test_phrases_of_common_words(spark, index, tmp_path, monkeypatch, one_in):
    """Whatever counts as common, results are the same, and no postings of a common word with a neighbour are read."""
    monkeypatch.setattr(dictionary, "COMMON_ONE_IN", one_in)
    own = index_over(spark, DOCS, str(tmp_path / "own"))
    read = set()
    meet = s._meet

    def watched(words, *rest):
        read.update(r["term"] for r in words.select("term").collect())
        return meet(words, *rest)

    monkeypatch.setattr(s, "_meet", watched)
    phrases = ["the then", "on no", "on on on", "rare word on on no", "no such phrase", "a the a", "night knight night noon", "word", "the"]
    rows = [one("phrase", p, query=q) for q, p in enumerate(phrases)]
    close(s.search(own, clauses(spark, rows), kinds=("phrase",), occurs=("should",)), brute(rows, 25))
    terms = {r["term"]: r["df"] for r in own.terms().collect()}
    assert not {w for w in read if terms[w] * one_in >= own.n_docs} - {"word", "the"}
    mixed = [one("phrase", "on no", query=0), one("phrase", "on no", query=1, slop=2), one("phrase", "on on on", query=1, clause=1)]
    close(s.search(own, clauses(spark, mixed), kinds=("phrase",), occurs=("should",)), brute(mixed, 25))


def test_pairs_leave_gaps_and_removed_documents_out(spark, tmp_path):
    words = {0: ["to", "be", "or", "not", "to", "be"], 1: ["to"], 2: ["be", "to"], 3: ["rare"] * 3}
    first = index_over(spark, words, str(tmp_path / "pairs"))
    rows = Dictionary(first).pairs().select("first", "second", "doc_id", "pos", "len").collect()
    want = [("be", "or", 0, [1], 6), ("be", "to", 2, [0], 2), ("not", "to", 0, [3], 6), ("or", "not", 0, [2], 6), ("rare", "rare", 3, [0, 1], 3), ("to", "be", 0, [0, 4], 6)]
    assert sorted(map(tuple, rows)) == want
    listing = first.docs().where("doc_id <> 0").select("doc_id", "path", "id", "stamp")
    later = refresh_index(first, listing, lambda changed: first.forward().limit(0).selectExpr("doc_id", "field", "array('') as values"))
    assert sorted(r[:2] for r in Dictionary(later).pairs().select("first", "second").collect()) == [("be", "to"), ("rare", "rare")]
    # a second value stands far from the first, and a stop word leaves a gap
    gone = spark.createDataFrame([(5, ["x the y", "z"])], "doc_id bigint, values array<string>")
    listing = gone.selectExpr("doc_id", "'p' as path", "'x' as id", "1L as stamp")
    texts = gone.select("doc_id", F.lit("body").alias("field"), "values")
    assert Dictionary(write_index(listing, texts, str(tmp_path / "gaps"), stop_words=("the",))).pairs().count() == 0


def test_phrase_mixed_with_words(spark, index):
    rows = [one("phrase", "the then", occur="must"), one("term", "on", clause=1), one("term", "cab", clause=2, occur="must_not")]
    close(s.search(index, clauses(spark, rows)), brute(rows, 25))


def test_nothing_to_find(spark, index):
    rows = [one("term", "absent"), one("phrase", "absent words", query=2)]
    assert s.search(index, clauses(spark, rows)).isEmpty()
    blank = s.query_words(spark.createDataFrame([(1, "  "), (2, None)], "query_id bigint, text string"), field="body")
    assert s.search(index, blank, kinds=("term",)).isEmpty()


def test_query_words_count_repeats(spark):
    rows = s.query_words(spark.createDataFrame([(1, "On no ON")], "query_id bigint, text string"), field="body").collect()
    assert {(r.term, r.times, r.clause_id) for r in rows} == {("on", 2, 0), ("no", 1, 1)}


def test_top_k_beyond_the_group_limit(spark):
    results = spark.range(5000).selectExpr("id % 2 as query_id", "id as doc_id", "cast(id % 7 as double) as score")
    got = {(r.query_id, r["rank"], r.doc_id) for r in s.top_k(results, 1500).collect()}
    want = set()
    for q in (0, 1):
        order = sorted((-(d % 7), d) for d in range(q, 5000, 2))
        want |= {(q, i, d) for i, (_, d) in enumerate(order[:1500], 1)}
    assert got == want


def test_algebra_of_results(spark, index):
    def docs(frame):
        return {r.doc_id for r in frame.collect()}

    def word(w, occur="should"):
        return s.scored(s.clause_hits(index, clauses(spark, [one("term", w, query=0, occur=occur)]), ("term",), (occur,)))

    a, b = word("night"), word("noon")
    have = lambda w: {d for d, doc in DOCS.items() if w in doc}
    assert docs(s.any_of(a, b)) == have("night") | have("noon")
    assert docs(s.all_of(a, b)) == have("night") & have("noon")
    assert docs(s.none_of(a, b)) == have("night") - have("noon")
    assert docs(s.none_of(s.match_all(index), b)) == set(DOCS) - have("noon")
    phrase = s.clause_hits(index, clauses(spark, [one("phrase", "night noon", query=0)]), ("phrase",), ("should",))
    assert docs(phrase) <= docs(s.all_of(a, b))


def test_removed_documents_are_not_found(spark, tmp_path):
    index = index_over(spark, DOCS, str(tmp_path))
    listing = index.docs().drop("gen").where("doc_id >= 30")
    after = refresh_index(index, listing, lambda changed: None)
    rows = [one("term", "the"), one("prefix", "a", query=2), one("phrase", "on no", query=3, slop=2)]
    hits = s.search(after, clauses(spark, rows), 100).collect()
    assert hits and all(r.doc_id >= 30 for r in hits)
    before = s.search(index, clauses(spark, rows), 100).collect()
    assert any(r.doc_id < 30 for r in before)


def test_plan_of_a_ranked_search(spark, index):
    ranked = s.search(index, clauses(spark, [one("term", "the")]), kinds=("term",), occurs=("should",))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "bucket#" in plan.split("PartitionFilters: [")[2] and "pos" not in plan.split("ReadSchema")[-1]


def test_shuffled_join_gives_the_same(spark, index, monkeypatch):
    rows = [one("term", w, clause=i, query=q) for q in range(3) for i, w in enumerate(VOCABULARY)]
    rows += [one("phrase", "the then", query=4, slop=1)]
    monkeypatch.setattr(s, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = s.search(index, clauses(spark, rows), kinds=("term", "phrase"), occurs=("should",))
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [bucket" in plan and "slice" in plan
        close(ranked, brute(rows, 25))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rejected_clauses_are_reported_and_their_queries_give_nothing(spark, index):
    bad = {2: "a(b", 3: "*a", 4: "[z-a]", 5: "a{3,1}", 6: "a\\q", 7: "(?<x>a)", 8: "a)", 9: "[a", 10: "x{,2}", 11: "a**", 12: "[a[b]]"}
    rows = [one("regexp", "th.*", query=1), one("fuzzy", "night", slop=3, query=13), one("wildcard", None, query=14), one("guess", "on", query=15)]
    rows += [one("regexp", p, query=q) for q, p in bad.items()] + [one("regexp", "on", query=q, clause=1) for q in bad]
    found = s.rejected_clauses(clauses(spark, rows)).collect()
    assert {r.query_id for r in found} == {*bad, 13, 14, 15} and all(r.reason and r.clause_id == 0 for r in found)
    hits = s.search(index, clauses(spark, rows), 100).collect()
    assert {r.query_id for r in hits} == {1}


def test_patterns_that_fix_no_gram(spark, index):
    rows = [one("regexp", p, query=q) for q, p in enumerate(["[a-z]+", ".?.?", "a|on", "(no)+n?", "n.*", ".*t", "[^a]b*", "no{1,2}n?", "th(e|a)n?", "\\d+", "a+b?c*d*"])]
    rows += [one("wildcard", p, query=20 + q) for q, p in enumerate(["*", "?", "??", "*n", "n?*", "*igh*"])]
    close(s.search(index, clauses(spark, rows), 100), brute(rows, 100))


def test_a_prefix_reads_one_part_of_the_dictionary(spark, tmp_path, monkeypatch):
    from letterloom.operators import dictionary

    monkeypatch.setattr(dictionary, "TERMS_PER_PART", 3)
    index = index_over(spark, DOCS, str(tmp_path))
    words = Dictionary(index).words()
    assert words.select("part").distinct().count() > 4
    for rows in ([one("prefix", "night")], [one("range", "the", "then")], [one("prefix", ""), one("range", None, "ab", query=2), one("range", "the", None, query=3)]):
        close(s.search(index, clauses(spark, rows), 100), brute(rows, 100))
    found = expand_in(with_reasons(clauses(spark, [one("prefix", "night")])).withColumn("pattern", F.lit(1)), Dictionary(index), ("prefix",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[[^\]]*part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert len((read[1] or read[2]).split(",")) <= 2
    assert sorted(r.term for r in found.collect()) == ["night"]


def test_matches_are_not_shuffled_before_they_are_ranked(spark, index):
    """Postings go to their documents' tasks once, and are multiplied by the queries there."""
    rows = [one("term", "the", query=q) for q in range(4)] + [one("range", "no", "the", query=q, clause=1) for q in range(4)]
    rows += [one("wildcard", "n*t", query=q, clause=2) for q in range(4)] + [one("phrase", "the then", slop=1, query=q, clause=3) for q in range(4)]
    for kinds in (("term",), ("range",), ("wildcard",), ("phrase",)):
        own = [r for r in rows if r[3] in kinds]
        ranked = s.search(index, clauses(spark, own), kinds=kinds, occurs=("should",))
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(doc_id#\d+L, \d+\), REPARTITION_BY_NUM", plan)
        assert not re.search(r"Exchange hashpartitioning\((?!doc_id#\d+L, \d+\)|query_id#\d+L, \d+\))", plan)


def test_ranges_within_and_across_each_other(spark, index):
    ends = [None, "a", "ab", "abc", "cab", "no", "the", "than", "then", "élan"]
    pairs = [(a, b) for a in ends for b in ends if a is None or b is None or a <= b] + [("the", "no"), ("x", "x")]
    rows = [one("range", a, b, query=q) for q, (a, b) in enumerate(pairs)] + [one("prefix", p, query=200 + q) for q, p in enumerate(["t", "th", "tha", ""])]
    close(s.search(index, clauses(spark, rows), 100, kinds=("range", "prefix"), occurs=("should",)), brute(rows, 100))


def test_a_repeated_word_looks_at_what_lies_beside_it(spark):
    """One word at 20,000 places of a document, twice in a phrase: pairs of all places would take minutes."""
    rows = spark.sql("""SELECT sequence(0, 60000, 3) AS far, array(0, 2, 9, 10, 20) AS few""")
    w = lambda pos: F.array(*[F.struct(F.lit(i).alias("i"), F.lit("x").alias("term"), F.col(pos).alias("pos")) for i in (0, 1)])
    begun = time.monotonic()
    got = rows.select(*[s.phrase_frequency(w(pos), F.lit(n)) for pos in ("far", "few") for n in (1, 2)]).first()
    assert time.monotonic() - begun < 40
    def count(pos, slop):
        spot = lambda p, q, at: p <= at + slop and p >= at and q >= at + 1 and q <= at + 1 + slop
        return sum(any(spot(p, q, at) for at in range(p - slop, p + 1) for q in pos if q != p) for p in pos)
    few = [0, 2, 9, 10, 20]
    far = list(range(0, 601, 3))
    assert list(got)[2:] == [count(few, 1), count(few, 2)]
    assert (got[0] > 0) == (count(far, 1) > 0) and (got[1] > 0) == (count(far, 2) > 0)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_two_words_near_each_other_are_counted_in_one_pass(spark, tmp_path, monkeypatch):
    """The words of a document are held against those beside them, not the places of each phrase; documents that came twice as before."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    rows = spark.createDataFrame(docs + docs[:6] + [(7, docs[8][1]), (9, "a x a"), (60, "x a a"), (60, "x a a")], "doc_id bigint, text string")
    listing = rows.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit("x").alias("id"), F.lit(1).cast("bigint").alias("stamp"))
    texts = rows.select("doc_id", F.lit("body").alias("field"), F.array("text").alias("values"))
    index = write_index(listing, texts, str(tmp_path / "index"), stop_words=())
    words = ["a b", "b a", "a a", "c g", "g g", "x a", "a x", "d e f", "e e e", "absent a"]
    asked = [one("phrase", w, slop=slop, query=10 * slop + q, clause=slop) for q, w in enumerate(words) for slop in range(4)]
    asked += [one("phrase", "a b", slop=2, query=100, clause=c, boost=1.0 + c) for c in range(3)]

    def hits():
        found = s.clause_hits(index, clauses(spark, asked), ("phrase",), ("should",))
        return found, sorted((r.query_id, r.clause_id, r.doc_id, round(r.weight, 9)) for r in found.collect())

    now, got = hits()
    assert "MapInArrow" in plan_of(now)
    monkeypatch.setattr(s, "NEAR", -1)
    before, want = hits()
    assert "MapInArrow" not in plan_of(before) and got == want and len(got) > 300
    # few documents hold the rarest words: the others are left out before they are dealt
    monkeypatch.setattr(s, "NEAR", 64)
    monkeypatch.setattr(s, "BROADCAST_BYTES", 20_000)
    assert hits()[1] == want


def test_misspelt_words_of_the_best_documents_are_summed_where_they_are(spark, index, monkeypatch):
    """No table holds documents times patterns or clauses, and the dictionary is spelt as it is read."""
    rows = [one("fuzzy", w, slop=slop, query=q, clause=c, boost=1.0 + c) for q, c, w, slop in itertools.product(range(4), range(3), ["then", "nigth", "a", "élon", "zzzzz"], range(3)) if (q + c + slop) % 2]
    rows = [(*r[:1], i, *r[2:]) for i, r in enumerate(rows)]
    found = s.search(index, clauses(spark, rows), 100, kinds=("fuzzy",), occurs=("should",))
    close(found, brute(rows, 100))
    assert "MapInArrow" in plan_of(found) and "Generate" not in plan_of(found)
    few = s.search(index, clauses(spark, rows), 3, kinds=("fuzzy",), occurs=("should",))
    close(few, brute(rows, 3))
    monkeypatch.setattr("letterloom.operators.expand.SPELT_AT_ONCE", 0)
    assert sorted(few.collect()) == sorted(s.search(index, clauses(spark, rows), 3, kinds=("fuzzy",), occurs=("should",)).collect())
