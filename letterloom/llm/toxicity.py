"""Toxicity by gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Labelled texts that are not held out are dealt by a hash of the text to three parts: one gives the lexicon (words that toxic
texts hold more often than others), one the trees, one the calibration, so neither trees nor calibration see texts
that the words were taken from. Texts are then scored with a lexicon learned alike from all three. Features are densities: lexicon words, lexicon words near a second person, capitals,
punctuation, obfuscated spellings. Nothing but the text enters a score.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from letterloom.llm.common import map_batches
from letterloom.llm.language import held_out
from letterloom.session import written

# Bound of the sample: so many labelled texts of each class are expected, chosen by hash; weights make up for it.
TRAIN_TEXTS = 20_000
# The labelled texts' parts, of 100.
LEXICON_PART, TREES_PART = 35, 80
# A lexicon of at most so many words; each is in so many toxic texts of its part and associated with them (G squared, p < 0.0001).
LEXICON_WORDS = 1000
# Lengths of the stems that stand beside whole words: inflected and compounded forms share them.
STEMS = (4, 5, 6, 7)
# Words whose kind a Python worker remembers.
KNOWN_WORDS = 200_000
LEAST_TEXTS = 3
LEAST_G2 = 15.1
# Words whose association is this share of the strongest word's count as strong.
STRONG_SHARE = 0.1
TREES, DEPTH, STEP = 24, 3, 0.3
THRESHOLD = 0.3
# How many words lie between a lexicon word and a second person at most.
NEAR = 5
# Words of a stretch whose lexicon words are counted for themselves, so that a long text hides none.
STRETCH = 100
# Equal calibrated scores keep the trees' order by this share of their own score.
ORDER_SHARE = 1e-3

# Second persons of the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner deinem deinen euch euer eure tu te toi ton ta tes vous votre vos ti tú usted ustedes tuyo vosotros".split()
)
_LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGES = string.punctuation + "«»„“”‚‘’…¡¿–—"
_INNER = re.compile(r"[^\w]|_")
_LETTERS = re.compile(r"[^\W\d_]+")
_REPEATS = re.compile(r"(.)\1{2,}")
_MARKS = re.compile(r"[!?]{2,}")
_SYMBOLS = re.compile(r"[#$%&*@^~]+")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\S)")

FEATURES = (
    "strong_density strong_log strong_distinct weak_density weak_log stretch_most near_density near_log second_density capitals all_caps "
    "exclamations questions mark_runs symbols odd_words obfuscated_density obfuscated_log digits words_log"
).split()


class _Kinds(dict):
    """1 for a strong word, 2 for a weak one, 3 for a second person, 0 for others; what was looked up is remembered, up to a bound."""

    def __init__(self, entries: dict[str, int]):
        self.entries = entries

    def __missing__(self, word: str) -> int:
        found = [self.entries[own] for own in _entries_of(word) if own in self.entries]
        kind = min(found) if found else 3 if word in SECOND_PERSON else 0
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = kind
        return kind


def _entries_of(word: str) -> list[str]:
    """The word and its stems (with a star), under which a lexicon may hold it."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


@dataclass
class Lexicon:
    """Words and stems, each strong (1) or weak (2)."""

    entries: dict[str, int]

    def __post_init__(self) -> None:
        self.kinds = _Kinds(self.entries)
        words = [w for w, kind in self.entries.items() if kind == 1 and w[-1] != "*"]
        self.strong = frozenset(words)
        # what is left of a word if a sign hides an inner letter
        self.masked = frozenset((w[:i], w[i + 1 :]) for w in words for i in range(1, len(w) - 1) if len(w) > 3)

    def reveals(self, core: str) -> bool:
        """Whether an odd spelling stands for a strong word: look-alike signs, signs between letters, stretched letters or a hidden letter."""
        plain = core.translate(_LEET)
        for word in {_INNER.sub("", plain), _INNER.sub("", core)}:
            for own in {word, _REPEATS.sub(r"\1", word), _REPEATS.sub(r"\1\1", word)}:
                if own.isalpha() and self.kinds[own] == 1:
                    return True
        return any(not c.isalnum() and (core[:i], core[i + 1 :]) in self.masked for i, c in enumerate(core))


def _share(n: float, of: int) -> float:
    return n / of if of else 0.0


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text (null: as if empty); all zero without words."""
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    lowered = text.lower().split()
    cores = [t if t.isalpha() else t.strip(_EDGES) for t in lowered]
    kinds = lexicon.kinds
    hits: list[tuple[int, int, str]] = []
    odd = hidden = 0
    for at, core in enumerate(cores):
        if not core:
            continue
        if core.isalpha():
            kind = kinds[core]
            if not kind and _REPEATS.search(core) and lexicon.reveals(core):
                kind, hidden = 1, hidden + 1
            if kind:
                hits.append((at, kind, core))
            continue
        odd += 1
        # parts of a compound count as words of their own
        parts = [(at, kinds[p], p) for p in _LETTERS.findall(core) if kinds[p]]
        if not any(kind == 1 for _, kind, _ in parts) and lexicon.reveals(core):
            hidden += 1
            parts.append((at, 1, core))
        hits += parts
    for spelled in _SPELLED.finditer(text):
        word = "".join(_LETTERS.findall(spelled[0].lower()))
        for own in lexicon.strong:
            times = word.count(own)
            hidden += times
            hits += [(int(n * spelled.start() / len(text)), 1, own)] * times
    strong = sorted(at for at, kind, _ in hits if kind == 1)
    second = [at for at, kind, _ in hits if kind == 3]
    weak = sum(kind == 2 for _, kind, _ in hits)
    most = Counter(at // STRETCH for at in strong)
    near, j = 0, 0
    for at in strong:
        while j < len(second) and second[j] < at - NEAR:
            j += 1
        near += j < len(second) and second[j] <= at + NEAR
    letters = sum(map(len, cores)) or 1
    raw = text.encode()
    capitals, digits = (len(raw) - len(raw.translate(None, own.encode())) for own in (string.ascii_uppercase, string.digits))
    values = [
        _share(100 * len(strong), n),
        log1p(len(strong)),
        float(len({w for _, kind, w in hits if kind == 1})),
        _share(100 * weak, n),
        log1p(weak),
        float(max(most.values(), default=0)),
        _share(100 * near, n),
        log1p(near),
        _share(100 * len(second), n),
        _share(capitals, letters),
        _share(sum(t.isupper() and len(t) > 1 for t in tokens), n),
        _share(100 * text.count("!"), letters),
        _share(100 * text.count("?"), letters),
        _share(100 * len(_MARKS.findall(text)), n),
        _share(100 * len(_SYMBOLS.findall(text)), n),
        _share(100 * odd, n),
        _share(100 * hidden, n),
        log1p(hidden),
        _share(digits, letters),
        log1p(n),
    ]
    return [float(v) for v in values]


def _with_features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with an array ``features`` in place of ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # LEXICON_WORDS words
    kept = [c for c in rows.columns if c != "text"]
    schema = StructType(rows.select(*kept).schema.fields).add("features", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = pa.array([features(t.as_py(), own) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*kept, "features"])

    return map_batches(rows.select(*kept, "text"), run, schema)


# Learning


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", texts: int = TRAIN_TEXTS) -> DataFrame:
    """``text, toxic (0 or 1), weight, part (0 to 99)`` of labelled rows of ``docs``, about ``texts`` of each class at most.

    A key with several labels takes the highest; null keys, texts and labels are no sample. The keys are chosen by their hash before
    any text is read, so at most about twice ``texts`` of them are sent to the tasks that read texts.
    """
    own = labels.select(F.col(key).alias("key"), F.col(label).alias("toxic")).where("key is not null and toxic is not null")
    own = own.groupBy("key").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = own.groupBy("toxic").agg(F.count("*").alias("size"))
    share = F.least(F.lit(1.0), F.lit(float(texts)) / F.col("size"))
    place = F.xxhash64(F.lit("sample"), "key") / F.lit(2.0**64) + 0.5
    chosen = own.join(F.broadcast(sizes), "toxic").where(place <= share).select("key", "toxic", (1 / share).alias("weight"))
    chosen = F.broadcast(written(chosen, "toxicity-chosen"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").join(chosen, "key")
    part = F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(100)).cast("int").alias("part")
    return rows.select("text", "toxic", "weight", part)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words that toxic texts of the sample hold more often than the others, by G squared over texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                cores = {core for t in text.as_py().lower().split() if (core := t.strip(_EDGES)).isalpha()}
                held[toxic].update({own for core in cores for own in _entries_of(core)})
            words = list(held[0] | held[1])
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(words, pa.string()), "clean": pa.array([held[0][w] for w in words], pa.int64()), "bad": pa.array([held[1][w] for w in words], pa.int64())}
            )

    counted = map_batches(sample.select("text", "toxic"), run, "word string, clean bigint, bad bigint")
    words = counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    texts = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("all")).first()
    rows, held = words.where(F.col("bad") >= LEAST_TEXTS), F.col("clean") + F.col("bad")

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = F.lit(0.0)
    for n, seen in ((texts["bad"], F.col("bad")), (texts["all"] - texts["bad"], F.col("clean"))):
        g2 = g2 + term(seen, n * held / max(texts["all"], 1)) + term(n - seen, n * (texts["all"] - held) / max(texts["all"], 1))
    rows = rows.withColumn("g2", 2 * g2).where((F.col("g2") >= LEAST_G2) & (F.col("bad") * texts["all"] > held * texts["bad"]))
    best = [tuple(r) for r in rows.orderBy(F.desc("g2"), "word").limit(LEXICON_WORDS).select("word", "g2").collect()]
    return Lexicon({w: 1 if g >= STRONG_SHARE * best[0][1] else 2 for w, g in best})


@dataclass
class Model:
    """Lexicon, trees and calibration; without trees every text has the score ``base``."""

    lexicon: Lexicon
    base: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score`` in place of ``text``."""
        kept = [c for c in rows.columns if c != "text"]
        if self.trees is None:
            return rows.select(*kept, F.lit(self.base).alias("score"))
        rows = _probability(self.trees, _with_features(rows, self.lexicon), kept)
        if self.calibration is None:
            return rows.withColumnRenamed("own", "score")
        rows = self.calibration.setFeaturesCol("own").setPredictionCol("even").transform(rows)
        score = F.col("even") + ORDER_SHARE * (F.col("own") - F.col("even"))
        return rows.select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def _probability(trees: GBTClassificationModel, rows: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` and the trees' own probability ``own``."""
    vectors = rows.select(*kept, array_to_vector("features").alias("features"))
    return trees.transform(vectors).select(*kept, vector_to_array("probability")[1].alias("own"))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that the labels of rows not held out give."""
    sample = labelled_sample(docs.where(~held_out(F.col("doc_id"))), labels)
    sample = written(sample, "toxicity-sample")
    part = learn_lexicon(sample.where(F.col("part") < LEXICON_PART))
    rows = written(_with_features(sample.where(F.col("part") >= LEXICON_PART), part), "toxicity-features")
    lexicon = learn_lexicon(sample)
    sums = rows.agg(F.sum("weight").alias("all"), F.sum(F.col("weight") * F.col("toxic")).alias("bad")).first()
    if not sums["all"]:
        return Model(lexicon, 0.0)
    base = sums["bad"] / sums["all"]
    fit = rows.where(F.col("part") < TREES_PART)
    if fit.select("toxic").distinct().count() < 2:
        return Model(lexicon, base)
    trees = GBTClassifier(
        featuresCol="features", labelCol="toxic", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=17
    ).fit(fit.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("toxic"), "weight"))
    rest = _probability(trees, rows.where(F.col("part") >= TREES_PART), ["toxic", "weight"])
    if rest.select("toxic").distinct().count() < 2:
        return Model(lexicon, base, trees)
    calibration = IsotonicRegression(featuresCol="own", labelCol="toxic", weightCol="weight").fit(rest.withColumn("toxic", F.col("toxic").cast("double")))
    return Model(lexicon, base, trees, calibration)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    A null text is scored as an empty one. If the labels hold one class only, every text gets its share as score, and 0 if there
    are none. Repeated rows and null keys each get a row; other columns are not read; an empty table gives no rows.
    """
    model = learn(docs, labels)
    rows = model.scored(docs.select("doc_id", "text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
