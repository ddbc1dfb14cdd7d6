"""The streaming encoder and decoder against the library."""

import hashlib
import random

import numpy as np
import pytest

from flowlens.llm import bpe, tokens
from flowlens.llm.queries import QUERIES

from .conftest import ODD

PARTS = ["a", "b", "e", "th", "er", " ", "  ", "\n", " \n", "\t", "1", "23", "'s", "'", "!", "...", "é", "ß", "日本", "<|endoftext|>", "<|endo", "😀",
         "\x1c", "\xa0", "'re", "-", "="]


def own(text, path, size):
    parts = [text[i:i + size] for i in range(0, len(text), size)]
    return np.frombuffer(b"".join(bpe.encode_stream(parts, path)), "<u4").tolist()


def test_any_cut_gives_the_same_ids(vocab, library):
    rng = random.Random(1)
    fast = tokens.LibraryEncoder(vocab)
    for _ in range(800):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        for size in (1, 3, 7, 1000):
            assert own(text, vocab, size) == want, text
        assert np.frombuffer(fast.encode([text])[0], "<u4").tolist() == want, text


def test_long_words_use_the_lookahead(vocab, library):
    table, look, _ = bpe.worker_table(vocab)
    assert 0 < look < 4096
    rng = random.Random(2)
    pieces = [w for b in table.bytes_of if (w := b.decode("utf-8", "ignore").strip()).isalpha()]
    for i in range(12):
        text = "".join(rng.choice(pieces) for _ in range(4000)) if i % 2 else rng.choice(["a", "ab", "=", "1", "\n", "-=", " "]) * 90_000
        text = rng.choice(["", "x ", "  "]) + text + rng.choice(["", " y", "\n", "'s"])
        want = library.encode(text, add_special_tokens=False).ids
        assert own(text, vocab, 1000) == want and own(text, vocab, 1 << 16) == want


def test_buffer_stays_bounded(vocab):
    table, look, memo = bpe.worker_table(vocab)
    encoder = bpe.Encoder(table, look, memo)
    for _ in range(400):
        encoder.feed("ab" * 2000)
        held = len(encoder.text) + (len(encoder.transducer.held) if encoder.transducer else 0)
        assert held < 40_000
    encoder.finish()


def test_decoder_state_machine(vocab, library):
    table = bpe.worker_table(vocab)[0]
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(30)]
        d = bpe.Decoder(table)
        assert "".join(d.feed([i]) for i in ids) + d.finish() == library.decode(ids, skip_special_tokens=False)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_query_equals_library(spark, small, texts, library):
    rows = QUERIES["op2_bpe_stream"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, texts[r["doc_id"]])


def test_odd_rows(odd, none, vocab, library):
    rows = bpe.round_trips(odd, vocab).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    assert got == sorted((str(i), *expected(library, t)) for i, t in ODD)
    assert bpe.round_trips(none, vocab).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(odd, vocab), vocab).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(i), t or "") for i, t in ODD)
    assert pytest.approx(0) == bpe.encode_texts(none, vocab).count()
