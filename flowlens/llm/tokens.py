"""Token ids of whole texts by the tokenizers library.

A word with the space or newline before it is encoded on its own, so its ids do not depend on where it stands. The texts
of a slice are cut there in Arrow, equal words become one number, words met before come from a memo of bounded size and
the library encodes the new ones; the ids of all words are then gathered at once. Texts in which such a cut could fall inside
a token go to the library whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.cloudpickle import register_pickle_by_value

from .common import worker_store

register_pickle_by_value(sys.modules[__name__])

# White space of any kind. Fixed values.
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# A space or newline between two white spaces, or after one at the end: the only ones that may lie inside a token.
INSIDE = rf"[{SPACE}][ \n](?:[{SPACE}]|\z)"
# Words and ids kept, without and with the new ones of a slice; longest word kept.
MEMO_BYTES, MEMO_CHARS, JOINED_WORDS = 16 << 20, 40, 1000
SLICE_BYTES = 2 << 20
# Marks that may end a word, and how many ways to end one are kept.
TAIL, TAILS = ".,:;!?$#*&", 10_000


class LibraryEncoder:
    """Turns texts into little-endian 32-bit ids. Its memo holds the words used last."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from tokenizers import Tokenizer

        self.np, self.pa, self.pc, self.tok, self.memo_bytes = np, pa, pc, Tokenizer.from_file(path), memo_bytes
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for w, i in vocab.items() if w.startswith("Ġ")]] = True
        self.newline, self.merge, self.tails = vocab["Ċ"], self.tok.model.tokenize, {}
        self.line = np.array([self.newline], "<u4").tobytes()
        # The library's letter for each byte: itself where it can be seen, else one of the letters from U+0100 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict(zip(seen, seen)) | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(seen)))}
        # Slices that held a word count, older ones less: half of them are forgotten whenever words go.
        self.words, self.ids, self.met = pa.array([], pa.string()), pa.array([], pa.binary()), np.empty(0, np.float32)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], mark: str) -> list[bytes]:
        """Ids of words that neither begin nor end with white space, each with ``mark`` before it. Joined by a mark, each
        mark starts a token, so the ids can be told apart."""
        np, out = self.np, []
        for at in range(0, len(words), JOINED_WORDS):
            group = words[at:at + JOINED_WORDS]
            raw = self.whole([mark + mark.join(group)])[0]
            ids = np.frombuffer(raw, "<u4")
            starts = (np.flatnonzero(self.spaced[ids] if mark == " " else ids == self.newline) * 4).tolist()
            if len(starts) != len(group):
                raise AssertionError("a token spans words")
            out += [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]
        return out

    def _piece(self, text: str) -> bytes:
        """Ids of a text that the library does not cut any further, by its merges alone."""
        return self.np.array([t.id for t in self.merge(text.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word: with a space before it, unless it begins with a newline."""
        out, spaced, lined, odd = [b""] * len(words), [], [], []
        piece, tails, line = self._piece, self.tails, self.line
        for i, w in enumerate(words):
            inner = w[1:] if w[:1] == "\n" else w
            core = inner.rstrip(TAIL)
            if core.isalpha() and (core.isascii() or max(core) < "ɐ"):
                # Letters are one piece, and so are the marks after them.
                ids = line + piece(core) if inner is not w else piece(" " + core)
                if len(core) < len(inner):
                    tail = inner[len(core):]
                    if tail not in tails:
                        if len(tails) > TAILS:
                            tails.clear()
                        tails[tail] = piece(tail)
                    ids += tails[tail]
                out[i] = ids
            elif not inner or inner[0].isspace() or inner[-1].isspace():
                odd.append(i)
            else:
                (spaced if inner is w else lined).append(i)
        for at, ids in ((spaced, self._joined([words[i] for i in spaced], " ")), (lined, self._joined([words[i][1:] for i in lined], "\n")),
                        (odd, self.whole([words[i] if words[i][:1] == "\n" else " " + words[i] for i in odd]))):
            for i, x in zip(at, ids):
                out[i] = x
        return out

    def _ids_of(self, words):
        """Binary array of the ids of distinct ``words``, each with the space or newline before it."""
        np, pa, pc = self.np, self.pa, self.pc
        at = pc.index_in(words, value_set=self.words)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        place = pc.fill_null(at, -1).to_numpy().copy()
        self.met[place[known]] += 1
        new = words.filter(pa.array(~known))
        learnt = pa.array(self._learn(new.to_pylist()), pa.binary())
        place[~known] = len(self.words) + np.arange(len(new))
        # Gathered before long or old words go.
        out = pa.concat_arrays([self.ids, learnt]).take(pa.array(place))
        short = pc.less_equal(pc.utf8_length(new), MEMO_CHARS)
        new, learnt = new.filter(short), learnt.filter(short)
        words, ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, learnt])
        met = np.concatenate([self.met, np.ones(len(new), np.float32)])
        size = pc.add(pc.add(pc.binary_length(words), pc.binary_length(ids)), 12).to_numpy(zero_copy_only=False)
        if size.sum() > self.memo_bytes:  # the words met most stay, the newest of equals; half the space is free again
            order = np.argsort(-met[::-1], kind="stable")
            order = len(met) - 1 - order
            keep = np.sort(order[np.cumsum(size[order]) <= self.memo_bytes // 2])
            words, ids, met = words.take(pa.array(keep)), ids.take(pa.array(keep)), met[keep] / 2
        self.words, self.ids, self.met = words, ids, met
        return out

    def _cut(self, texts):
        """(ids, offsets) of texts that may be cut before their spaces and newlines."""
        np, pa, pc = self.np, self.pa, self.pc
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().copy()
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        # The first word of a text has no space before it.
        first, place = np.unique(codes[at[:-1]], return_inverse=True)
        heads = pa.array(self.whole(coded.dictionary.take(pa.array(first)).to_pylist()), pa.binary())
        ids = pa.concat_arrays([self._ids_of(coded.dictionary), heads])
        codes[at[:-1]] = len(coded.dictionary) + place
        joined = ids.take(pa.array(codes))
        _, ends, data = joined.buffers()
        ends = np.frombuffer(ends, "<i4")[joined.offset:joined.offset + len(joined) + 1]
        return np.frombuffer(data, "<u4")[ends[0] // 4:ends[-1] // 4], (ends[at].astype(np.int64) - ends[0]) // 4

    def encode_array(self, texts):
        """(ids, offsets): the ids of all texts of a string array without nulls, one after another, and where each begins."""
        np, pa, pc = self.np, self.pa, self.pc
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        apart = pc.match_substring_regex(texts, INSIDE)
        for s in self.special:
            apart = pc.or_(apart, pc.match_substring(texts, s))
        apart = apart.to_numpy(zero_copy_only=False)
        if not apart.any():
            return self._cut(texts)
        own = self.whole(texts.filter(pa.array(apart)).to_pylist())
        sizes = np.zeros(len(texts), np.int64)
        sizes[apart] = [len(x) // 4 for x in own]
        ids, offsets = self._cut(texts.filter(pa.array(~apart))) if not apart.all() else (np.empty(0, "<u4"), np.zeros(1, np.int64))
        sizes[~apart] = np.diff(offsets)
        out = np.empty(sizes.sum(), "<u4")
        mine = np.repeat(apart, sizes)
        out[mine], out[~mine] = np.frombuffer(b"".join(own), "<u4"), ids
        return out, np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.encode_array(self.pa.array(texts, self.pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]

    def encode_ended(self, texts, end: int):
        """As ``encode_array``, with ``end`` after the ids of each text."""
        np = self.np
        ids, offsets = self.encode_array(texts)
        offsets = offsets + np.arange(len(offsets))
        out, rest = np.full(offsets[-1], end, "<u4"), np.ones(offsets[-1], bool)
        rest[offsets[1:] - 1] = False
        out[rest] = ids
        return out, offsets


def library_encoder(path: str) -> LibraryEncoder:
    store = worker_store()
    key = ("library", path)
    if key not in store:
        store[key] = LibraryEncoder(path)
    return store[key]


def sliced(batch, column: int = 1, size: int = SLICE_BYTES) -> Iterator:
    """(slice of a record batch, its texts without nulls), of about ``size`` bytes of text each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(batch.column(column).cast(pa.string()), "")
    slot = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(slot)]]).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)


def slices(texts: Iterable[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``chars`` characters each; a null text is empty."""
    at, group, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if group and size + len(t) > chars:
            yield at, group
            at, group, size = i, [], 0
        group.append(t)
        size += len(t)
    if group:
        yield at, group
