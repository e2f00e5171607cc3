import pytest

from letterloom.llm import toxicity
from letterloom.llm.toxicity import FEATURES, Lexicon, features, labelled_sample, toxicity_report
from tests.llm.data import AWKWARD, clashing, documents

COLUMNS = ["doc_id", "held_out", "score", "predicted"]
LEXICON = Lexicon({"idiot": 1, "scum": 1, "stup*": 1, "silly": 2})


def values(text):
    found = features(text, LEXICON)
    assert len(found) == len(FEATURES)
    return dict(zip(FEATURES, found, strict=True))


@pytest.mark.parametrize("text", ["what an IDIOT!", "1d10t", "i.d.i.o.t", "id*ot", "idiiiiot", "i d i o t here", "STUPIDLY so", "scum-bag", "«idiot»"])
def test_strong_words_in_any_spelling(text):
    assert values(text)["strong_log"] > 0


@pytest.mark.parametrize("text", ["", None, " \n", "a clean text", "idea", "s c", "12 34", "silly"])
def test_others_are_not_strong(text):
    assert values(text)["strong_log"] == 0


def test_features_of_a_text():
    found = values("You are an idiot! The rest is calm. Silly scum?? $$$")
    assert found["strong_density"] == pytest.approx(100 * 2 / 11) and found["weak_density"] == pytest.approx(100 / 11)
    assert found["near_density"] == pytest.approx(100 / 11) and found["second_density"] == pytest.approx(100 / 11)
    assert found["mark_runs"] > 0 and found["symbols"] > 0 and found["exclamations"] > 0
    far = values("idiot " + "calm " * 20_000 + "you")
    assert far["near_density"] == 0 and far["stretch_most"] == 1


def given(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, key string, row string")


def training(n):
    """Every fifth text insults; words are dealt by number, so no text is like another."""
    calm = [f"{c}{v}{d}" for c in "bdfgl" for v in "aeiou" for d in "mnrst"]
    docs, labels = [], []
    for i in range(n):
        words = [calm[(i * 7 + j * (i % 11 + 3)) % len(calm)] for j in range(30 + i % 13)]
        if i % 5 == 0:
            words[i % 17 + 1 : i % 17 + 1] = ["you", ["moron", "clown", "loser"][i // 5 % 3]]
        docs.append((i + 100, " ".join(words), "en", "s"))
        labels.append((i + 100, 1, int(i % 5 == 0), "k", "r"))
    return docs, labels


def test_held_out_texts_are_told_apart(spark):
    docs, labels = training(900)
    planted = [(5000, "long calm words " * 9000 + " you moron", "en", "s"), (5001, "long calm words " * 900, "en", "s")]
    found = toxicity_report(clashing(documents(spark, [*docs, *planted, *AWKWARD]).repartition(3)), given(spark, labels))
    assert found.columns == COLUMNS
    rows = found.collect()
    assert len(rows) == len(docs) + 2 + len(AWKWARD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    truth = {d: t for d, _, t, *_ in labels}
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert 150 < len(out) < 300
    assert all(r["predicted"] == truth[r["doc_id"]] for r in out)
    score = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] is not None and r["doc_id"] >= 5000}
    assert score[5000] > score[5001]
    again = {(r["doc_id"], r["score"]) for r in toxicity_report(documents(spark, docs), given(spark, labels)).collect() if r["doc_id"] in truth}
    assert len(again) == len(docs)


def test_labels_of_one_class_or_none(spark):
    df = documents(spark, AWKWARD)
    for rows, share in (([], 0.0), ([(3, 1, 1, "", ""), (6, 1, 1, "", "")], 1.0), ([(3, 0, 0, "", ""), (None, 0, 1, "", ""), (6, 0, None, "", "")], 0.0)):
        found = toxicity_report(df, given(spark, rows)).collect()
        assert len(found) == len(AWKWARD) and all(r["score"] == share for r in found)
    assert toxicity_report(documents(spark), given(spark, [])).collect() == []


def test_sample_is_bounded_and_weighted(spark):
    docs, labels = training(600)
    labels += [(105, 1, 0, "", ""), (101, 1, None, "", ""), (99_999, 1, 1, "", "")]
    rows = labelled_sample(documents(spark, docs), given(spark, labels), texts=60).collect()
    for toxic, size in ((0, 480), (1, 120)):
        own = [r for r in rows if r["toxic"] == toxic]
        assert 30 < len(own) < 100 and sum(r["weight"] for r in own) == pytest.approx(size, rel=0.4)
    assert {r["part"] for r in rows} <= set(range(100))
    assert toxicity.TRAIN_TEXTS >= 60
