"""Special tokens count in their own case only."""

import pyarrow as pa
import pytest
from test_operators import BYTES, WORDS
from tokenizers import Tokenizer

from keyfold.llm.token_files import Encoder


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_special_strings_in_any_case(path):
    texts = [
        "a <|ENDOFTEXT|> b", "A <|EndOfText|>, B.", "x<|startoftext|>Y <|STARTOFTEXT|>", "<|endoftext|><|ENDOFTEXT|>", "<|ENDOFTEXT|>\n<|endoftext|> Plain TEXT.",
        "É<|EndOfText|>é", "<|end oftext|> <|END", "",
    ]
    tok = Tokenizer.from_file(path)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    got = [list(memoryview(raw).cast("I")) for raw in Encoder(path)(pa.array(texts))]
    assert got == want
