"""What an id and a word may cost."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lociq.llm import range_coder, token_output

with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
    SPEC = f.read()


def test_an_id_narrows_the_range_once(monkeypatch):
    ids = np.random.default_rng(1).zipf(1.3, 4096).clip(0, 300).astype(np.uint32)
    calls = {}
    for kind in (range_coder._Writer, range_coder._Reader):
        own, calls[kind] = kind.narrow, 0

        def narrow(self, *args, kind=kind, own=own):
            calls[kind] += 1
            own(self, *args)

        monkeypatch.setattr(kind, "narrow", narrow)
    coded = range_coder.encode([ids])
    assert np.array_equal(range_coder.decode(coded)[0], ids)
    # Once an id, and once for each distinct id's value.
    assert set(calls.values()) == {len(ids) + len(np.unique(ids))}


def test_blocks_of_any_length_and_carries():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, 2 ** int(bits), int(n)) for bits, n in zip(rng.integers(1, 33, 120), rng.integers(1, 700, 120), strict=True)]
    blocks += [np.repeat(rng.integers(0, 9, 512), 8), np.array([5]), np.array([5, 5])]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))


def test_words_without_white_space_are_split_into_pieces(monkeypatch):
    words = "It's it'S WE'LL x'y''s a1b22c ... (foo), Foo foo. 'S ''' don't'll &amp; <|end a_b-c~!! été, \x7f \x1c".split(" ")
    whole = Tokenizer.from_str(SPEC.decode())
    plain, given = token_output._ids_of_words, []
    monkeypatch.setattr(token_output, "_ids_of_words", lambda words, *args: (given.extend(words), plain(words, *args))[1])
    got = token_output.tokenise([" ".join(words).encode(), "foo".encode()], SPEC)
    assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in (" ".join(words), "foo")]
    assert set(given) == {"\x7f", "\x1c"}


def test_other_words_are_the_library_s_too():
    rng = np.random.default_rng(3)
    kinds = [(0x20, 0x250), (0x300, 0x370), (0x391, 0x3D0), (0x900, 0x950), (0x1100, 0x11C3), (0x1680, 0x1681), (0x180E, 0x180F), (0x2000, 0x2070), (0x3000, 0x3010), (0xAC00, 0xAC20), (0xFEFF, 0xFF00), (0x1F640, 0x1F650)]
    pool = [chr(c) for a, b in kinds for c in range(a, b)] + ["'s", " ", "Σ", "\u0130", "\u0085"] * 30
    texts = ["".join(pool[i] for i in rng.integers(0, len(pool), n)) for n in rng.integers(0, 80, 3000)]
    whole = Tokenizer.from_str(SPEC.decode()).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in token_output.tokenise([t.encode() for t in texts], SPEC)] == [e.ids for e in whole]
