import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from letterloom.llm import alignment
from letterloom.llm.alignment import alignment_report, pair_counts, postings
from tests.llm.data import AWKWARD, clashing, documents, sample

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def bytes_of_a(token):
    # the library's own decoder tells the byte of each character
    return b"".join(_one_byte(c) for c in A.id_to_token(token))


_SEEN = {}


def _one_byte(c):
    if not _SEEN:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        _SEEN.update({chr(b): bytes([b]) for b in shown} | {chr(256 + i): bytes([b]) for i, b in enumerate(hidden)})
    return _SEEN[c]


def bytes_of_b(token):
    piece = B.id_to_piece(token)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(token) else piece.replace("▁", " ").encode()


def plain(text):
    """Groups ``[(a ids, b ids)]`` of one whole text."""
    if not text:
        return []
    raw = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if b"".join(map(bytes_of_a, a)) != raw or b"".join(map(bytes_of_b, b)) != raw:
        return []
    ends = lambda ids, size: {sum(map(len, map(size, ids[: i + 1]))): i for i in range(len(ids))} if len(ids) < 300 else _ends(ids, size)
    ends_a, ends_b = ends(a, bytes_of_a), ends(b, bytes_of_b)
    out, x, y = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        out.append((a[x : ends_a[end] + 1], b[y : ends_b[end] + 1]))
        x, y = ends_a[end] + 1, ends_b[end] + 1
    return out


def _ends(ids, size):
    out, at = {}, 0
    for i, t in enumerate(ids):
        at += len(size(t))
        out[at] = i
    return out


def plain_report(rows):
    groups = [(key, plain(text)) for key, text in rows]
    links = Counter((a[-1], b[-1]) for _, own in groups for a, b in own)
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for key, own in groups:
        pairs = [(a[-1], b[-1]) for a, b in own]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        sha = hashlib.sha256(text.encode()).hexdigest() if own else ""
        best = sum(links[p] == most[p[1]] for p in pairs)
        out.append((key, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(own), best, sum(links[p] for p in pairs), sha))
    return sorted(out, key=str)


def report(df):
    found = alignment_report(df)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


ODD = [
    (20, " led by a space", None, None),
    (21, "two  spaces\n\nand lines \n mixed\t tab\r\nend ", None, None),
    (22, "a ▁ mark", None, None),
    (23, "plain <|endoftext|> in text<|endoftext|>", None, None),
    (24, "\nstarts with a line", None, None),
    (25, "ends with a space ", None, None),
    (26, "ends with a line\n", None, None),
    (27, "<0x0A> </s> <unk> \x00 nul", None, None),
    (28, " ", None, None),
    (29, "\n", None, None),
    (30, "é ẛ̣ ﬁ Å 　 \xa0x ​\U0001f468‍\U0001f469", None, None),
    (31, "x\ry \rz;\r q", None, None),
    (32, "12345 1,000.50 don't we'll isn't", None, None),
]


def test_awkward_rows(spark):
    rows = [*AWKWARD, *ODD]
    assert report(clashing(documents(spark, rows))) == plain_report([(i, t) for i, t, *_ in rows])
    assert report(documents(spark)) == []


def test_given_texts(spark):
    df = sample(spark).repartition(3)
    assert report(df) == plain_report([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_pieces_are_forgotten_and_blocks_cut(spark, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_PIECES", 5)
    monkeypatch.setattr(alignment, "JOINED", 3)
    aligner = alignment.PieceAligner(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    texts = ["one two three", "two three four five six seven", None, "one  two", "eight nine\nten", ""]
    for at in (0, 2, 4):
        n_a, n_b, groups, docs, pairs = aligner.align(pa.array(texts[at : at + 2]))
        for i, text in enumerate(texts[at : at + 2]):
            own = plain(text)
            assert (n_a[i], n_b[i]) == (sum(len(a) for a, _ in own), sum(len(b) for _, b in own))
            assert groups[i] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
            assert sorted(pairs[docs == i].tolist()) == sorted(a[-1] << 32 | b[-1] for a, b in own)


def test_pair_counts_from_planes(spark, monkeypatch):
    """Dense and sparse bitmaps, words up to nine times in a text, and blocks of several parts."""
    monkeypatch.setattr(alignment, "TEXTS_TOGETHER", 70)
    rows = [(i, " ".join(["the"] * (i % 10) + ["rare"] * (i % 97 == 0) + [f"n{i}"]), None, None) for i in range(600)]
    df = documents(spark, rows).coalesce(1)
    links, held = Counter(), Counter()
    for _, text, *_ in rows:
        own = Counter((a[-1], b[-1]) for a, b in plain(text))
        links.update(own)
        held.update(own.keys())
    found = {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in pair_counts(postings(df)).collect()}
    assert found == {p: (held[p], links[p]) for p in links}
    assert report(df) == plain_report([(i, t) for i, t, *_ in rows])
