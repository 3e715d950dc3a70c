"""Texts that hold an added token of the vocabulary."""
import random
import zlib

import numpy as np

from courtlake.llm import packing


def test_added_tokens_have_their_own_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, parts = random.Random(6), [" ", "  ", "\n", "a", "é", "The", "<|endoftext|>", "<|endoftext|", "|>"]
    texts = ["hi <|endoftext|> you", "<|endoftext|>", "<|endoftext|><|endoftext|>", ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        expect = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert r.ids == expect and r.length == len(expect), texts[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(expect, "<u4").tobytes())
    assert next(r.ids for r in got if r.doc_id == 0) == [5303, 220, 50256, 345, 2]
