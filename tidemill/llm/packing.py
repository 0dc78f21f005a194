"""Packing documents into sequences by the sum-of-squares rule.

Documents are tokenized, ended with a separator, and cut only where they are longer than a sequence. The pieces
are dealt into blocks of a fixed expected size, and each block is packed on its own: longest first, each piece goes where the
squared counts of open bins per residual gap, summed, become smallest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, ranges, slices, text_or_empty, trim

SEQUENCE, SEPARATOR = 1024, 2
#: Pieces in a block, about. Waste at a block's end is a few sequences at most.
BLOCK_PIECES = 8192
#: Pre-tokens whose ids a worker remembers at once, from task to task.
MOST_REMEMBERED = 200_000
#: Pre-tokens that the tokenizer gets in one text.
TOGETHER = 200
#: Bytes of text that are encoded at once.
ENCODED_BYTES = 4 << 20

# What the vectorised splitter below knows: texts in ASCII and Latin letters up to U+02AF, and the one pre-tokenizer that splits them so.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼½¾", r"\t\n\x0b\x0c\r "
_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_LETTERS, _NUMBERS, _SPACES, _OTHERS, _NONE = 1, 2, 3, 4, 0


def _classes() -> np.ndarray:
    """The class of each code point up to U+02AF; 0 for those that the splitter doesn't know."""
    kinds = ((_LETTERS, f"[{_LETTER}]"), (_NUMBERS, f"[{_NUMBER}]"), (_SPACES, f"[{_SPACE}]"), (_OTHERS, "[!-~¡-ʯ]"))
    return np.array([next((k for k, p in kinds if re.fullmatch(p, chr(c))), _NONE) for c in range(0x2B0)], np.uint8)


_CLASS = _classes()


def classes_of(data: np.ndarray) -> np.ndarray:
    """The class of the character of each byte of UTF-8; both bytes of a two-byte character have its class."""
    out = np.where(data < 128, _CLASS[data & 127], _NONE).astype(np.uint8)
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xCA))
    lead = lead[lead + 1 < len(data)]
    code = ((data[lead].astype(np.int32) & 31) << 6) | (data[lead + 1] & 63)
    kind = np.where(code < len(_CLASS), _CLASS[np.minimum(code, len(_CLASS) - 1)], _NONE)
    out[lead] = kind
    out[lead + 1] = kind
    return out


def pre_token_starts(data: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each byte. ``ends``: where each text ends; all bytes are of known classes.

    A run of a class is a pre-token. Of white space before something else the last character stands alone, or goes with what follows
    if it is a space. An apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll after it.
    """
    size = len(data)
    starts = np.zeros(size + 4, bool)
    starts[:size][1:] = kind[1:] != kind[:-1]
    edge = np.zeros(size + 4, bool)
    edge[0] = True
    edge[ends] = True
    starts |= edge
    last = np.flatnonzero((kind[:-1] == _SPACES) & (kind[1:] != _SPACES) & ~edge[1:size])
    starts[last] = True
    starts[last[data[last] == 0x20] + 1] = False
    mark = np.flatnonzero(data == 0x27)
    mark = mark[starts[mark] & ~edge[mark + 1]]
    if len(mark):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = one.astype(np.int32) << 8 | two
        long = np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")]) & ~edge[mark + 2]
        starts[mark[short | long] + 1] = False
        starts[mark[short] + 2] = True
        starts[mark[long] + 3] = True
    return starts[:size]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts by the tokenizer of a file.

    Byte-level BPE works on each pre-token alone. So texts of the plain alphabet are split with array operations, equal pre-tokens
    meet, and the tokenizer is asked for the ids of those that aren't remembered from before. Texts outside that alphabet or with a special
    token's string, and all texts if the file's tokenizer splits in another way, go through it as a whole.
    """

    def __init__(self, file: str, most: int = MOST_REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(file), most
        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        split = told.get("pre_tokenizer") or {}
        self.splits = told.get("normalizer") is None and all(split.get(k) == v for k, v in _SPLITTER.items())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_break = line_break[0] if len(line_break) == 1 else None
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(space)]] = True
        self.forget()

    def forget(self) -> None:
        #: pre-token -> its place in the arrays of starts and lengths in ``ids``.
        self.known: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _remember(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.known), len(pieces)
        while n + m > len(self.start):
            self.start, self.length, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.used))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.length[n : n + m] = lengths
        self.start[n : n + m] = self.n_ids + np.cumsum(lengths) - lengths
        self.n_ids += len(ids)
        self.known.update(zip(pieces, range(n, n + m), strict=True))

    def _shrink(self) -> None:
        """Half of what may be remembered stays: what was used most often, old uses counting less."""
        n = len(self.known)
        kept = np.sort(np.argsort(-self.used[:n], kind="stable")[: self.most // 2])
        pieces, start, length, used, ids = list(self.known), self.start[kept], self.length[kept], self.used[kept] // 2, self.ids
        self.forget()
        self._remember([pieces[k] for k in kept.tolist()], ids[ranges(start, length)], length)
        self.used[: len(kept)] = used

    def learn(self, new: list[bytes]) -> None:
        """Remember new pre-tokens. The tokenizer gets many in one text and splits it there again: those that begin with their only
        space one after another, as no other id of theirs begins with one, and the others a line each, as a line break
        followed by no other white space is a pre-token of its own; what holds one goes alone."""
        encode = self.tokenizer.encode_batch_fast
        kinds: tuple[list[bytes], list[bytes], list[bytes]] = ([], [], [])
        for p in new:
            spaced = p[:1] == b" " and len(p) > 1 and not p.isspace()
            kinds[0 if spaced else 2 if self.line_break is None or b"\n" in p or p.isspace() else 1].append(p)
        for kind, (pieces, end) in enumerate(zip(kinds, (b"", b"\n", b""), strict=True)):
            if not pieces:
                continue
            step = 1 if kind == 2 else TOGETHER
            texts = [end.join([*pieces[i : i + step], b""]).decode() for i in range(0, len(pieces), step)]
            each = [e.ids for e in encode(texts, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(each), np.uint32, sum(map(len, each)))
            if kind == 0:
                lengths = np.diff(np.flatnonzero(self.spaced[ids]), append=len(ids))
            elif kind == 1:
                lengths = np.diff(np.flatnonzero(ids == self.line_break), prepend=-1) - 1
                ids = ids[ids != self.line_break]
            else:
                lengths = np.array([len(x) for x in each])
            if len(lengths) != len(pieces) or (lengths < 1).any():
                raise RuntimeError("the tokenizer doesn't split here as expected")
            self._remember(pieces, ids, lengths.astype(np.int32))

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, their classes, whether each text is of the plain alphabet)."""
        data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
        kind = classes_of(data)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        ok = np.full(len(texts), self.splits)
        ok[np.searchsorted(ends, np.flatnonzero(kind == _NONE), "right")] = False
        for s in self.special:
            ok &= ~pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return data, kind, ok

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them)."""
        data, kind, ok = self.plain(texts)
        if not ok.all():  # the plain ones together, the others each as a whole
            ids, offsets = self.encode(texts.filter(pa.array(ok))) if ok.any() else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
            parts = iter(np.split(ids, offsets[1:-1]) if ok.any() else [])
            others = iter(self.tokenizer.encode_batch_fast(texts.filter(pa.array(~ok)).to_pylist(), add_special_tokens=False))
            ids_of = [next(parts) if fine else np.array(next(others).ids, np.uint32) for fine in ok.tolist()]
            return np.concatenate(ids_of), np.concatenate([[0], np.cumsum([len(x) for x in ids_of])])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = np.flatnonzero(pre_token_starts(data, kind, ends))
        at = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        if len(self.known) > self.most:
            self._shrink()
        pieces = coded.dictionary.to_pylist()
        slots = np.array([self.known.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            self.learn([pieces[i] for i in new.tolist()])
            slots[new] = [self.known[pieces[i]] for i in new.tolist()]
        self.used[slots] += 1
        slots = slots[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.length[slots]
        before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        offsets = before[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return self.ids[ranges(self.start[slots], lengths)], offsets

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        ids, offsets = self.encode(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def cuts(n: int, length: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one if they fit, else full pieces after a first one of what is over."""
    first = n if n <= length else n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def all_cuts(n: np.ndarray, length: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces of each, start of each piece, length of each piece) for many documents of ``n`` ids, one at least."""
    first = np.where(n <= length, n, (n - 1) % length + 1)
    per = 1 + (n - first) // length
    piece = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.where(piece == 0, 0, np.repeat(first, per) + (piece - 1) * length)
    return per, start, np.where(piece == 0, np.repeat(first, per), length)


def sum_of_squares(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, taken in the order given.

    With N(g) open bins of residual gap g, moving a bin from g to g - s changes the sum of N(g)**2 by
    2 (N(g - s) - N(g)) + 2, and a full bin leaves the count. The open bin with the least change takes the piece, the tightest
    among equals; a new bin is opened where no open one can hold it.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    at, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max // 4
    for i, s in enumerate(lengths.tolist()):
        gap = capacity
        if s < capacity:
            open_ = count[s:capacity]
            change = 2 * (count[: capacity - s] - open_) + 2
            change[0] -= 1
            change[open_ == 0] = far
            k = int(change.argmin())
            if change[k] < far:
                gap = s + k
        if gap == capacity:
            b, used = used, used + 1
        else:
            b = bins[gap].pop()
            count[gap] -= 1
        at[i], offset[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            count[gap - s] += 1
    return at, offset


def pack_lengths(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """``sum_of_squares`` with the longest first."""
    order = np.argsort(-lengths, kind="stable")
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    at[order], offset[order] = sum_of_squares(lengths[order], capacity)
    return at, offset


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, separator: int = SEPARATOR, file: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32, row) for each piece of each document; null text is empty and gives the separator alone."""
    file = file or tokenizer_file()
    rows = df.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(file), TaskContext.get().partitionId() << 36
        for b in slices(batches, "text", ENCODED_BYTES):
            texts = b.column("text").dictionary_encode()
            # Equal texts are encoded once; each one's pieces are then repeated for its rows.
            ids, offsets = encode.encode(texts.dictionary)
            n = np.diff(offsets) + 1
            ended = np.full(len(ids) + len(n), separator, "<u4")
            ended[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            per, start, size = all_cuts(n, length)
            first = np.cumsum(per) - per
            a = 4 * (np.repeat(np.cumsum(n) - n, per) + start)
            raw = memoryview(ended.tobytes())
            crc = np.fromiter((zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), (a + 4 * size).tolist(), strict=True)), np.int64, len(a))
            own = texts.indices.to_numpy(zero_copy_only=False)
            at = ranges(first[own], per[own])
            columns = [np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), per[own]), at - np.repeat(first[own], per[own]), start[at], size[at], crc[at], np.arange(row, row + len(at))]
            if b.column("doc_id").null_count:
                columns[0] = b.column("doc_id").take(pa.array(np.repeat(np.arange(len(own)), per[own])))
            row += len(at)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(columns, kinds, strict=True)], names)
        trim()

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, separator: int = SEPARATOR, file: str | None = None, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """A row for each piece with its ``sequence_id`` and the ``offset`` in it; offsets in a sequence are gapless from 0.

    Null text is empty and gives the separator alone, a very long one as many pieces as it needs; only the key is kept of other columns, so no name can clash.
    An empty table gives no rows, and repeated rows are packed as rows of their own. Blocks are drawn by a hash of the row's
    number, so neither hot keys nor equal rows gather in one; their number follows the count of pieces. Texts are tokenized once: the narrow piece
    table is checkpointed. A sequence's id is its block's number and the bin's.
    """
    rows = checkpointed(pieces(df, key, text, length, separator, file))
    blocks = max(1, -(-rows.count() // block_pieces))

    def one(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("row", kind="stable")
        at, offset = pack_lengths(block["length"].to_numpy(), length)
        return block.assign(sequence_id=(block["block"].to_numpy(np.int64) << 32) + at, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(documents: DataFrame) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(documents)
