"""Added tokens of the vocabulary inside texts."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from docsieve.llm import packing


def test_added_tokens_are_those_of_the_json_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n\ny <|endoftext |> <|ENDOFTEXT|>", "it's  plain "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pieces(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert got[0] == [64, 220, 50256, 275, 0]
