"""BPE encoding with reuse of content-defined chunks.

A rolling hash cuts texts where their content says so, so that passages that
documents share become equal chunks. A worker encodes each chunk once while it
remembers it. The words that a cut may have torn are then encoded anew over the
joined text, from the last word border before the cut to the first after it,
wider until the ends agree with what the chunks gave.
"""

from __future__ import annotations

import os
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: A cut follows a byte where the hash of the last WIDTH bytes has its top CUT_BITS bits unset: chunks of about 1 KB.
WIDTH, CUT_BITS, LEAST, MOST = 24, 10, 256, 8192
#: Bytes of text whose encoding a worker remembers, and of the texts between chunks.
MEMORY, JOIN_MEMORY = 8 << 20, 1 << 20
#: Words whose ids a worker remembers.
WORDS, STEP = 400_000, 5000
#: Bytes of text that are encoded at a time.
BLOCK = 2 << 20
#: A space after white space, or white space beyond ASCII: such a text is encoded whole.
UNSURE = re.compile(rb"[\x00-\x20\x7f] |\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _FACTOR, np.uint64)
        steps[0] = 1
        have = _POWERS["p"] = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        _POWERS["q"] = np.multiply.accumulate(steps)
    return have[:n]


_MIX = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)


def cuts(text: bytes) -> list[int]:
    """Where chunks end: by content, at least LEAST and at most MOST bytes after the last cut, on a character border."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    data = np.frombuffer(text, np.uint8)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_MIX[data] * _powers(n), out=total[1:])
    rolling = (total[WIDTH:] - total[:-WIDTH]) * _POWERS["q"][: n + 1 - WIDTH]
    at = np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + WIDTH
    at = at[(at < n)]
    at = at[(data[at] & 0xC0) != 0x80]
    out, last = [], 0
    for p in [*at.tolist(), n]:
        while p - last > MOST:
            q = last + MOST
            while text[q] & 0xC0 == 0x80:
                q -= 1
            out.append(q)
            last = q
        if p - last >= LEAST or p == n:
            out.append(p)
            last = p
    return out


def borders(chunk: bytes) -> tuple[int, int] | None:
    """The first and last place in a chunk where words surely part: before a space after a printable ASCII byte, whatever stands around.

    None if there is no such place.
    """
    first = chunk.find(b" ", 1)
    while first > 0 and not 0x20 < chunk[first - 1] < 0x7F:
        first = chunk.find(b" ", first + 1)
    if first < 0:
        return None
    last = chunk.rfind(b" ")
    while not 0x20 < chunk[last - 1] < 0x7F:
        last = chunk.rfind(b" ", 0, last)
    return first, last


def parts(text: bytes) -> list[tuple[int, int]]:
    """Where a text's parts start and end: joins (even places) and what lies between the sure borders of each chunk (odd places), by turns."""
    out, last, join = [], 0, 0
    for end in cuts(text):
        inner = borders(text[last:end])
        if inner and inner[0] < inner[1]:
            out += [(join, last + inner[0]), (last + inner[0], last + inner[1])]
            join = last + inner[1]
        last = end
    return [*out, (join, len(text))]


def around(text: bytes, plan: list[tuple[int, int]], first: int, last: int) -> tuple[bytes, int, int, bytes]:
    """The word before the parts from ``first`` to ``last``, where they start and end, and the word after them."""
    left = right = b""
    if first:
        a, b = plan[first - 1]
        left = text[max(text.rfind(b" ", a, b), a) : b]
    if last + 1 < len(plan):
        a, b = plan[last + 1]
        stop = text.find(b" ", a + 1, b)
        right = text[a : stop if stop > 0 else b]
    return left, plan[first][0], plan[last][1], right


def within(joined: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """The ids of a join without those of the words on both sides, which must come out as they do inside their chunks; else None."""
    stop = len(joined) - len(right)
    if stop < len(left) or (joined[: len(left)] != left).any() or (joined[stop:] != right).any():
        return None
    return joined[len(left) : stop]


class Memory:
    """Remembers results up to a number of text bytes; the oldest go first."""

    def __init__(self, most: int):
        self.most, self.size, self.kept = most, 0, OrderedDict()

    def get(self, key: bytes):
        if (found := self.kept.get(key)) is not None:
            self.kept.move_to_end(key)
        return found

    def put(self, key: bytes, value) -> None:
        self.kept[key] = value
        self.size += len(key)
        while self.size > self.most:
            self.size -= len(self.kept.popitem(last=False)[0])


class Encoder:
    """One tokenizer with its remembered chunks; a worker process keeps one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.chunks, self.joins = Memory(MEMORY), Memory(JOIN_MEMORY)
        self.words: dict[bytes, bytes] = {b"": b""}
        self.size = 0
        special = {i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        back = {c: b for b, c in enumerate(byte_letters())}
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.pieces = pa.array([t.encode() if i in special else bytes(back[c] for c in t) for i, t in enumerate(tokens)], pa.large_binary())
        self.sizes = np.array([len(x) for x in self.pieces.to_pylist()])
        self.digits = pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        self.encoded = self.reused = self.widened = 0

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Encode texts by their words, each word as it stands after a space that surely parts it; other texts whole."""
        plans, new = [], {}
        for t in texts:
            parts = [t] if not t or UNSURE.search(t) else [x if not i else b" " + x for i, x in enumerate(t.split(b" "))]
            plans.append(parts)
            for x in parts:
                if x and x not in self.words:
                    new[x] = None
        if new:
            self._learn(list(new))
            self.size += sum(map(len, new))
        out = [np.frombuffer(b"".join([self.words[x] for x in parts]), self.dtype) for parts in plans]
        if len(self.words) > WORDS or self.size > MEMORY:  # at most a block of texts above the bounds
            self.words = {b"": b""}
            self.size = 0
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Encode words that aren't known. Words that surely part from what follows go to the library joined; where its tokens don't end with a word, alone."""
        plain = [x for x in new if x[0] == 32 and x[-1] > 32 and x[-1] != 127 and b"<|" not in x]
        alone = set(new).difference(plain)
        joined = [plain[lo : lo + STEP] for lo in range(0, len(plain), STEP)]
        width = self.dtype().itemsize
        for part in joined:
            (encoded,) = self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)
            ids = np.array(encoded.ids, self.dtype)
            ends = np.cumsum([len(x) for x in part])
            reach = np.cumsum(self.sizes[ids])
            stop = np.searchsorted(reach, ends)
            ok = (stop < len(reach)) & (reach[np.minimum(stop, len(reach) - 1)] == ends)
            ok[1:] &= ok[:-1]  # a word also has to begin with a token
            data, at = ids.tobytes(), ((stop + 1) * width).tolist()
            start = 0
            for x, good, end in zip(part, ok.tolist(), at, strict=True):
                if good:
                    self.words[x] = data[start:end]
                else:
                    alone.add(x)
                start = end
        rest = list(alone)
        for lo in range(0, len(rest), STEP):  # the library's results are large
            part = rest[lo : lo + STEP]
            encoded = self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)
            self.words.update((x, np.array(e.ids, self.dtype).tobytes()) for x, e in zip(part, encoded, strict=True))

    def _once(self, memory: Memory, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        out, new = {}, []
        for t in texts:
            if t in out:
                self.reused += 1
            elif (ids := memory.get(t)) is not None:
                out[t] = ids
                self.reused += 1
            else:
                out[t] = None
                new.append(t)
        for t, ids in zip(new, self._encode(new), strict=True):
            out[t] = ids
            memory.put(t, ids)
        self.encoded += len(new)
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, equal to those of encoding it whole."""
        plans = [parts(t) for t in texts]
        inner = self._once(self.chunks, [t[a:b] for t, p in zip(texts, plans, strict=True) for a, b in p[1::2]])
        spans = [[around(t, p, i, i) for i in range(0, len(p), 2)] for t, p in zip(texts, plans, strict=True)]
        joins = self._once(self.joins, list({x for t, own in zip(texts, spans, strict=True) for left, a, b, right in own for x in (left + t[a:b] + right, left, right)}))
        out = []
        for text, plan, own in zip(texts, plans, spans, strict=True):
            done: list[tuple[int, int, np.ndarray]] = []  # first and last part, ids
            i = 0
            while i < len(plan):
                if i % 2:
                    a, b = plan[i]
                    done.append((i, i, inner[text[a:b]]))
                    i += 1
                    continue
                first, last, (left, a, b, right) = i, i, own[i // 2]
                ids = within(*(joins[x] for x in (left + text[a:b] + right, left, right)))
                while ids is None:  # wider by a chunk on either side; the widest join is the text
                    first, last = max(first - 2, 0), min(last + 2, len(plan) - 1)
                    while done and done[-1][1] >= first:
                        first = min(first, done.pop()[0])
                    left, a, b, right = around(text, plan, first, last)
                    ids = within(*self._encode([left + text[a:b] + right, left, right]))
                    self.widened += 1
                done.append((first, last, ids))
                i = last + 1
            out.append(np.concatenate([ids for _, _, ids in done]))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The bytes of each id, one after the other; torn characters become U+FFFD, as in the library."""
        return [_gather(self.pieces, x).decode("utf-8", "replace") for x in ids]

    def decimal(self, ids: list[np.ndarray]) -> list[str]:
        return [_gather(self.digits, x)[:-1].decode() for x in ids]


def _gather(table: pa.Array, ids: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    taken = table.take(pa.array(ids))
    return taken.buffers()[2].to_pybytes()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints in Latin-1, else the next free letter from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", drop_text: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int), as the tokenizers library encodes each whole text without special tokens added; with ``decoded`` also a column of that name, the text of the ids.

    ``vocabulary`` is a tokenizers file of byte-level BPE that every worker can
    open. Strings of special tokens inside a text become their ids, as in the
    library. Null counts as empty: no ids. Columns named like a new one are
    replaced.
    """

    def run(part: pa.RecordBatch) -> dict:
        own = encoder(vocabulary)
        ids = own.encode(C.texts(part.column(text_col)))
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        out = {"token_ids": pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))}
        return out | {"decoded": pa.array(own.decode(ids), pa.string())} if decoded else out

    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())][: 1 + decoded]
    return C.add_columns(C.as_text(docs, text_col), run, fields, text_col, drop=(text_col,) * drop_text, block=BLOCK)


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that the library decodes from an array of ids; null gives null."""
    size = C.free_name(docs, "__size")

    def run(part: pa.RecordBatch) -> dict:
        return {out_col: pa.array([None if x is None else encoder(vocabulary).decode([np.array(x, np.int64)])[0] for x in part.column(ids_col).to_pylist()], pa.string())}

    return C.add_columns(docs.withColumn(size, F.lit("").cast("binary")), run, [T.StructField(out_col, T.StringType())], size, drop=(size,))


def encode_and_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_text`` (decimal ids, comma-joined) and ``decoded`` (the text of the ids), in one pass. Null counts as empty."""

    def run(part: pa.RecordBatch) -> dict:
        own = encoder(vocabulary)
        ids = own.encode(C.texts(part.column(text_col)))
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_text": pa.array(own.decimal(ids), pa.string()), "decoded": pa.array(own.decode(ids), pa.string())}

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_text", T.StringType()), T.StructField("decoded", T.StringType())]
    return C.add_columns(C.as_text(docs, text_col), run, fields, text_col, drop=(text_col,) * drop_text, block=BLOCK)
