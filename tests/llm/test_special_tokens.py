"""Special tokens' literals inside texts get the ids that the vocabulary file fixes."""

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from letterloom.llm import tokens
from tests.llm.data import documents

END = "<|endoftext|>"
TEXTS = [f"foo{END} bar", f"{END} at the start", f"at the end {END}", f"a {END} b", f"x\n{END}\ny", f"{END}{END} z", f"two  spaces {END}  and", END, f" {END}", "<|endoftext", f"<|{END}|> q"]


def test_literals_of_special_tokens(spark):
    fixed = Tokenizer.from_file(tokens.VOCABULARY)
    assert fixed.encode(TEXTS[0], add_special_tokens=False).ids == [21943, 50256, 2318]
    want = [fixed.encode(t, add_special_tokens=False).ids for t in TEXTS]
    coder = tokens.PieceEncoder(tokens.VOCABULARY)
    for _ in range(2):  # the second time from memory
        assert [ids.tolist() for ids in coder.encode(pa.array(TEXTS))] == want
    got = tokens.encode_documents(documents(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)])).collect()
    full = [ids + [2] for ids in want]
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(full)}
