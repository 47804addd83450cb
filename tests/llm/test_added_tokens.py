"""Packed ids of texts that spell out an added token, against the unaltered library."""

import numpy as np
from tokenizers import Tokenizer

import public_tokenizers
from spanframe.llm import packing

TEXTS = ["<|endoftext|>", "a b <|endoftext|> c", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", " a  <|endoftext|>\n", "<|endoftext", "q" * 3000 + "<|endoftext|> r", "plain words", ""]


def test_packing_takes_the_ids_of_the_library(spark):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: full.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {}
    for r in sorted(packing.pack_documents(df, with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: [*ids, packing.END_ID] for i, ids in want.items()} and want[0] == [50256]
