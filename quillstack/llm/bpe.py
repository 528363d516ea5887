"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

A vocabulary file of the tokenizers library is read once per Python process. Encoding cuts a text at
added tokens, then into pieces by the file's pre-tokenizer, and merges each piece: the heap holds
(rank, position) of every mergeable neighbour pair, entries whose symbols have changed since are
stale and skipped, and a piece costs O(n log n) however long it is. Results are remembered for each
blank-separated chunk in a bounded table. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Unicode white space, and the two pre-tokenizer patterns of the vocabulary files.
SPACE = r"\t-\r \x85\xa0  -     　"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


#: A heap entry is a merge rank above forty bits of position, so it orders by rank and then from the left.
PLACES = (1 << 40) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """Remembers make(key) for up to `cap` keys; when full it starts again, so memory stays bounded."""

    def __init__(self, make: Callable, cap: int):
        super().__init__()
        self.make, self.cap = make, cap

    def __missing__(self, key):
        made = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.cap:
                self.clear()
            self[key] = made
        return made


class Bpe:
    """One vocabulary file: text to little-endian u32 ids, and ids to text."""

    def __init__(self, path: str, engine: str = "heap", cap: int = 800_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: what all added tokens begin with: a text without it holds none
        self.sign = os.path.commonprefix(list(self.added))
        self.letters = byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank << 40, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = [self.vocab.get(c, -1) for c in self.letters]
        self.last = [self.vocab.get(c + self.suffix, -1) for c in self.letters] if self.suffix else self.single
        back = {c: b for b, c in enumerate(self.letters)}
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s.removesuffix(self.suffix)) for s, i in self.vocab.items() if all(c in back for c in s.removesuffix(self.suffix))}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        most = max(self.strings, default=0) + 1
        self.pieces = Strings([self.strings.get(i, b"") for i in range(most)])
        self.decimals = Strings([b"%d," % i for i in range(most)])
        self.pattern = regex.compile(WORD_PATTERN if self.suffix else BYTE_PATTERN)
        self.merge = self._heap if engine == "heap" else self._ranked(pairs)
        self.spaced = Memo(lambda w: self._pieces(" " + w), cap)
        self.first = Memo(self._pieces, cap if self.suffix else cap // 4)
        self.newline = self._pieces("\n")
        self.odd_space = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")

    # -- one piece -----------------------------------------------------------------------------

    def _heap(self, piece: bytes) -> list[int]:
        ids = [self.single[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        n = len(ids)
        find = self.merges.get
        heap = [found[0] + i for i, pair in enumerate(zip(ids, ids[1:])) if (found := find(pair))]
        if not heap:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        if len(heap) > 1:
            heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & PLACES
            j = after[i]
            if j < 0 or (found := find((ids[i], ids[j]))) is None or found[0] + i != entry:
                continue  # stale: a symbol has been merged away since
            made = found[1]
            k = after[j]
            ids[i], ids[j], after[i], after[j] = made, -1, k, -1
            if k >= 0:
                before[k] = i
                if found := find((made, ids[k])):
                    push(heap, found[0] + i)
            h = before[i]
            if h >= 0 and (found := find((ids[h], made))):
                push(heap, found[0] + h)
        return [x for x in ids if x >= 0]

    def _ranked(self, pairs: list) -> Callable[[bytes], list[int]]:
        """The same merges by the tiktoken library: ranks of whole byte strings, in merge order.

        A word end is a 0xFF byte, which UTF-8 never holds, joined to its letter before all merges.
        """
        import tiktoken

        back = {c: b for b, c in enumerate(self.letters)}
        end = b"\xff" if self.suffix else b""
        raw = lambda s: bytes(back[c] for c in s.removesuffix(self.suffix)) + (end if self.suffix and s.endswith(self.suffix) else b"")
        order: dict[bytes, int] = {}
        real: list[int] = []
        for b in range(256):
            order[bytes([b])] = len(real)
            real.append(self.single[b])
        if self.suffix:
            for b in range(255):
                order[bytes([b, 255])] = len(real)
                real.append(self.last[b])
        for a, b in pairs:
            key = raw(a) + raw(b)
            if key not in order:
                order[key] = len(real)
                real.append(self.vocab[a + b])
        core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=order, special_tokens={})
        one = core._encode_single_piece
        if self.suffix:
            return lambda piece: [real[i] for i in one(piece + end)]
        return lambda piece: [real[i] for i in one(piece)]

    def _pieces(self, text: str) -> bytes:
        if self.suffix:
            if not text.isascii():
                text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
            else:
                text = text.lower()
        if text.isalpha() or (not self.suffix and text[1:].isalpha() and text[0] == " "):
            return array("I", self.merge(text.encode())).tobytes()
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.merge(piece.encode())
        return array("I", ids).tobytes()

    # -- whole texts ---------------------------------------------------------------------------

    def _segment(self, text: str) -> bytes:
        if not text:
            return b""
        if self.suffix:
            # white space is dropped and no piece spans it, so each run stands alone
            runs = regex.split(f"[{SPACE}]+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
            return b"".join(map(self.first.__getitem__, runs))
        if self.odd_space.search(text):
            return b"".join(map(self._piece_memo, self.pattern.findall(text)))
        # every blank and newline stands alone between visible characters: a blank belongs to what follows it
        out = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out.append(self.newline)
            out.append(self.first[words[0]])
            out.extend(map(self.spaced.__getitem__, words[1:]))
        return b"".join(out)

    def _piece_memo(self, piece: str) -> bytes:
        return self.spaced[piece[1:]] if len(piece) > 1 and piece[0] == " " and not piece[1].isspace() else self.first[piece]

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian u32 bytes; None and "" have none."""
        if not text:
            return b""
        if self.cut is None or self.sign not in text:
            return self._segment(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out.append(np.asarray([self.added[part]], dtype="<u4").tobytes() if k % 2 else self._segment(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.pieces.join(ids).decode("utf-8", "replace")


class Strings:
    """Byte strings by number, concatenated for an array of numbers without a Python step for each."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.asarray([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, numbers: np.ndarray, block: int = 1 << 16) -> bytes:
        out = []
        for at in range(0, len(numbers), block):
            part = numbers[at : at + block]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(self.starts[part] - ends + sizes, sizes)].tobytes())
        return b"".join(out)


@lru_cache(maxsize=4)
def codec(path: str, engine: str = "heap") -> Bpe:
    return Bpe(path, engine)


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each whole text encoded, and the ids decoded again.

    Null and empty texts have no ids: 0 tokens and the digests of the empty string. Repeated rows and
    null ids are encoded like any others. An empty table gives an empty result; other columns are
    ignored. There is no shuffle: each row stands alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column(1):
                ids = np.frombuffer(bpe.encode(text.as_py()), dtype="<u4")
                counts.append(len(ids))
                coded.append(hashlib.sha256(bpe.decimals.join(ids)[:-1]).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=OUT.fieldNames())

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, OUT)
