"""What ChunkEncoder (operators 1 and 5) does for chunks that it knows, and its test of white space."""

import random
import re
import time

import pytest

from quarry.llm import vocab


class Counting(dict):
    asked = 0

    def __getitem__(self, key):
        Counting.asked += 1
        return super().__getitem__(key)


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_known_chunks_are_looked_up_once(name, kind):
    from public_tokenizers import path

    coder = vocab.ChunkEncoder(path(name), kind)
    text = "x " + " ".join(f"word{i}" for i in range(2000)) + " x"
    coder.encode([text])
    coder.known, Counting.asked = Counting(coder.known), 0
    fresh = text.replace("x word0 ", "x newlymade, ")
    assert coder.encode([fresh]) == vocab.ChunkEncoder(path(name), kind).encode([fresh])
    assert Counting.asked < 20


def test_white_space_that_keeps_a_text_whole():
    plain = re.compile(r"\s\s|[\t\r]|^\s|\s$")
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices("ab .\n\t\r\x0b\xa0\x85é–", k=rng.randint(0, 6)))
        assert vocab.whole_byte(text) == (vocab.whole_word(text) or plain.search(text) is not None)
    long = "some words and\nlines " * 100_000 + "x"
    begun = time.process_time()
    assert not vocab.whole_word(long)
    odd, begun = time.process_time() - begun, time.process_time()
    assert plain.search(long) is None
    slow, begun = time.process_time() - begun, time.process_time()
    assert not vocab.whole_byte(long)
    assert time.process_time() - begun < odd + slow / 2


def test_op1_remembers_more_chunks_than_the_default():
    from quarry.llm import token_output

    assert vocab.CHUNK_LIMIT < token_output.REMEMBERED <= 1_000_000
