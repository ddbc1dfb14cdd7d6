"""Byte-level BPE as a streaming transducer, and its decoder.

Merges of lower rank happen first, so what stands to the right of a place can change the tokens there only
through chains of merges of falling rank. ``MergeTable.lookahead`` follows these chains through the merge list
and gives the number of bytes after which a token is certain. The encoder therefore reads a text in blocks,
emits a token once that many bytes behind it are known, and keeps a buffer of constant size, however long the
text or one word of it is. Words that occur often come from a memo of bounded size.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from collections.abc import Iterable, Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from .common import worker_store
from .tokens import slices

register_pickle_by_value(sys.modules[__name__])

# A space between two white spaces, or after one at the end: the only spaces that may lie inside a token.
INSIDE = re.compile(r"\s (?:\s|\Z)")
MEMO_WORDS, MEMO_CHARS = 500_000, 40

# Fixed value: the published pattern by which byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUNS = {"letter": r"\p{L}*", "number": r"\p{N}*", "other": r"[^\s\p{L}\p{N}]*", "space": r"\s*"}
BLOCK, HOLD, SHORT = 1 << 16, 4096, 48
NONE = 1 << 30


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class MergeTable:
    """Vocabulary and merge list of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for w, i in vocab.items():
            self.bytes_of[i] = b"".join(back[c] for c in w)
        for w, i in self.special.items():
            self.bytes_of[i] = w.encode()
        self.of_byte = [vocab[c] for c in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.parts: list[tuple[int, int]] = []
        for n, m in enumerate(merges):
            a, b = (m.split(" ") if isinstance(m, str) else m)
            self.rank[vocab[a] << 20 | vocab[b]] = n
            self.made.append(vocab[a + b])
            self.parts.append((vocab[a], vocab[b]))

    def lookahead(self) -> int:
        """Bytes to the right of a token that decide it.

        reach[x]: how far beyond x the merges (x, y) seen so far look: over y and as far as the making of y
        itself depends on its right. A merge (u, v) can be lost only to an earlier merge that takes the last
        part of v, or the last part of that part, and so on.
        """
        right = {m: b for m, (_, b) in zip(self.made, self.parts)}
        reach: dict[int, int] = {}
        for a, b in self.parts:
            far, x = 0, b
            while x is not None:
                far = max(far, reach.get(x, 0))
                x = right.get(x)
            reach[a] = max(reach.get(a, 0), len(self.bytes_of[b]) + far)
        return max(reach.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """The tokens of ``data``: always the merge of lowest rank, the leftmost of several."""
        if len(data) > SHORT:
            return self._merge_long(data)
        get, made = self.rank.get, self.made
        ids = [self.of_byte[b] for b in data]
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        get, made = self.rank.get, self.made
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 20 | ids[j], NONE) != r:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := get(ids[i] << 20 | ids[k], NONE)) != NONE:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := get(ids[h] << 20 | ids[i], NONE)) != NONE:
                heapq.heappush(heap, (s, h))
        return [x for x in ids if x >= 0]


class Transducer:
    """Tokens of one stretch that the pattern does not cut, from bytes that come in parts."""

    def __init__(self, table: MergeTable, lookahead: int) -> None:
        self.table, self.look, self.step, self.held = table, lookahead, max(HOLD, lookahead), b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out: list[int] = []
        while len(self.held) >= self.step + self.look + 1:
            window, end = self.held[:self.step + self.look], 0
            for t in self.table.merge(window):
                n = len(self.table.bytes_of[t])
                if end + n > self.step:
                    break
                out.append(t)
                end += n
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.table.merge(self.held), b""
        return out


class Encoder:
    """``feed`` takes text in parts of any size and returns ids that are certain; ``finish`` returns the rest."""

    def __init__(self, table: MergeTable, lookahead: int, memo: dict[str, bytes]) -> None:
        import array

        import regex

        self.table, self.look, self.memo, self.array = table, lookahead, memo, array.array
        self.pattern = regex.compile(PATTERN)
        self.runs = {k: regex.compile(v) for k, v in RUNS.items()}
        self.letter, self.number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
        self.text, self.run, self.transducer = "", None, None

    def feed(self, text: str) -> bytes:
        self.text += text
        return self._drain(False)

    def finish(self) -> bytes:
        out, self.text = self._drain(True), ""
        return out

    def _pack(self, ids: list[int]) -> bytes:
        got = self.array("I", ids)
        if sys.byteorder != "little":
            got.byteswap()
        return got.tobytes()

    def _drain(self, last: bool) -> bytes:
        out: list[bytes] = []
        while found := min(((at, w) for w in self.table.special if (at := self.text.find(w)) >= 0), default=None):
            at, w = found
            self._segment(self.text[:at], True, out)
            out.append(self._pack([self.table.special[w]]))
            self.text = self.text[at + len(w):]
        if last:
            self._segment(self.text, True, out)
            self.text = ""
        else:  # the start of a special token may stand at the end
            hold = max((n for w in self.table.special for n in range(1, len(w)) if self.text.endswith(w[:n])), default=0)
            body, tail = self.text[:len(self.text) - hold], self.text[len(self.text) - hold:]
            self.text = self._segment(body, False, out) + tail
        return b"".join(out)

    def _segment(self, text: str, last: bool, out: list[bytes]) -> str:
        """Encode what is certain of ``text``; returns what is not."""
        if self.run:
            text = self._go_on(text, last, out)
            if self.run:
                return text
        if last:
            out.append(self._words(text))
            return ""
        # A space before a character that is not white space always starts a token.
        at = len(text) - 1
        while (at := text.rfind(" ", 0, at)) > 0 and text[at + 1].isspace():
            pass
        if at > 0:
            out.append(self._words(text[:at]))
            text = text[at:]
        return self._long(text, out) if len(text) > HOLD else text

    def _long(self, text: str, out: list[bytes]) -> str:
        """A stretch without such a space: emit what ends well before its end, then follow the open run."""
        at = 0
        for m in self.pattern.finditer(text):
            if m.end() > len(text) - 8:
                break
            out.append(self._piece(m.group()))
            at = m.end()
        text = text[at:]
        if len(text) <= HOLD:
            return text
        c = text[1]
        self.run = "space" if c.isspace() else "letter" if self.letter.match(c) else "number" if self.number.match(c) else "other"
        self.transducer = Transducer(self.table, self.look)
        if self.run == "space":
            return self._go_on(text, False, out)
        out.append(self._pack(self.transducer.feed(text[:1].encode())))
        return self._go_on(text[1:], False, out)

    def _go_on(self, text: str, last: bool, out: list[bytes]) -> str:
        n = self.runs[self.run].match(text).end()
        ended = last or n < len(text)
        if self.run == "space" and n and not (last and n == len(text)):
            n -= 1  # the last white space goes with what follows
        out.append(self._pack(self.transducer.feed(text[:n].encode())))
        if ended:
            out.append(self._pack(self.transducer.finish()))
            self.run = self.transducer = None
        return text[n:]

    def _piece(self, piece: str) -> bytes:
        got = self.memo.get(piece)
        if got is None:
            data = piece.encode()
            if len(data) <= HOLD:
                got = self._pack(self.table.merge(data))
            else:
                t = Transducer(self.table, self.look)
                got = self._pack(t.feed(data) + t.finish())
            self._keep(piece, got)
        return got

    def _keep(self, piece: str, got: bytes) -> None:
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= 2 * MEMO_WORDS:
                self.memo.clear()
            self.memo[piece] = got

    def _words(self, text: str) -> bytes:
        if not text:
            return b""
        if INSIDE.search(text):
            return b"".join([self._piece(p) for p in self.pattern.findall(text)])
        first, *words = text.split(" ")
        memo, out = self.memo, [b"".join([self._piece(p) for p in self.pattern.findall(first)])]
        for w in words:
            w = " " + w
            got = memo.get(w)
            if got is None:
                pieces = [w] if w[1:].isascii() and w[1:].isalpha() else self.pattern.findall(w)
                got = b"".join([self._piece(p) for p in pieces])
                self._keep(w, got)
            out.append(got)
        return b"".join(out)


class Decoder:
    """Text from ids that come in parts; an unfinished character waits, at most three bytes of it."""

    def __init__(self, table: MergeTable) -> None:
        self.bytes_of, self.held = table.bytes_of, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data) - self._open(data[-3:])
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out

    @staticmethod
    def _open(tail: bytes) -> int:
        """Length of the character that ``tail`` begins but does not end."""
        for k in range(1, len(tail) + 1):
            b = tail[-k]
            if 0x80 <= b <= 0xBF:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            if need <= k:
                return 0
            # The second byte has a narrower range after these four.
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            return k if k == 1 or low <= tail[1 - k] <= high else 0
        return 0


def worker_table(path: str) -> tuple[MergeTable, int, dict[str, bytes]]:
    store = worker_store()
    if ("bpe", path) not in store:
        table = MergeTable(path)
        store["bpe", path] = (table, table.lookahead(), {})
    return store["bpe", path]


def encode_stream(parts: Iterable[str], path: str) -> Iterator[bytes]:
    """Ids, little-endian 32 bits each, of a text that comes in parts."""
    encoder = Encoder(*worker_table(path))
    for part in parts:
        if got := encoder.feed(part):
            yield got
    if got := encoder.finish():
        yield got


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every whole text. A null text is empty and has no ids; see ``round_trips`` for other cases."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at, texts in slices(b.column(1).to_pylist()):
                raw = [b"".join(encode_stream(blocks(t), path)) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
                values = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(raw)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id, ids; null ids give null. Bytes that are no text become U+FFFD."""

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for ids in b.column(1):
                d = Decoder(worker_table(path)[0])
                texts.append(None if not ids.is_valid else d.feed(ids.as_py()) + d.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def blocks(text: str) -> Iterator[str]:
    for i in range(0, len(text), BLOCK):
        yield text[i:i + BLOCK]


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded block by block.

    A null text is empty; an empty text has no ids and two hashes of nothing. Repeated rows give equal rows,
    null ids stay null, an empty table gives an empty one; other columns are not read.
    """

    def digest(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        table = worker_table(path)[0]
        decimal = [str(i) for i in range(len(table.bytes_of))]
        for b in batches:
            rows = []
            for text in b.column(1):
                n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(table)
                for raw in encode_stream(blocks(text.as_py() or ""), path):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    ids_hash.update((("," if n else "") + ",".join(map(decimal.__getitem__, ids))).encode())
                    text_hash.update(decoder.feed(ids).encode())
                    n += len(ids)
                text_hash.update(decoder.finish().encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
