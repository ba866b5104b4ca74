"""Texts that hold a tokenizer's added token."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from colophon.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_of_added_tokens_are_the_librarys_own():
    encoder, library = Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "one two<|endoftext|>three  four", "no <|endoftext| > here"):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode("a <|endoftext|> b"), "<u2").tolist() == [64, 220, 50256, 275]
