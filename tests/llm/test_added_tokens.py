"""Token ids against a tokenizer left at its defaults."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sextant.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n", " <|endoftext|", "tail <|endoftext|>", "\x1c <|endoftext|> \x85", "plain text "]


def test_added_tokens_are_single_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.encoder(path)
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(TEXTS[0]), "<u4").tolist() == [64, 220, 50256, 275]
