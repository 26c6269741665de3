"""Hierarchical packing of tokenized documents into sequences of several context sizes.

A document's full windows of the longest size are sequences of their own; what is left is routed to the smallest tier
that holds it. Tiers are packed from the longest to the shortest: a window's gap is filled with the largest documents of
shorter tiers that fit whole, then closed with a cut from the longest document left. Sequences of one tier are dealt
into step groups of equal tokens and nearly equal attention cost.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from doseframe.llm.text import byte_groups, split_at_space

TIERS = (256, 512, 1024, 2048, 4096)
STEP_TOKENS = 65_536
POOL_TOKENS = 1 << 21      # tokens packed at once; a longer document is one pool
GROUP_BYTES = 2 << 20      # texts tokenized at once
KEPT_WORDS, KEPT_PIECES, WORDS_AT_ONCE = 200_000, 100_000, 64
ID = np.dtype("<u4")

# Normalizer and splitter of the tokenizers whose words `Pieces` codes itself.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_LAST = b"\xff"   # behind the last byte of a piece; no byte of UTF-8
# ASCII, Latin, Greek, Cyrillic, kana, unified ideographs, syllables of Hangul: classes as old as any Unicode table.
_BLOCKS = ((0x21, 0x250), (0x384, 0x3CF), (0x400, 0x482), (0x48A, 0x500), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))


def _plain(c: str) -> bool:
    """Characters that are their own normal form beside any other of them, and whose lower case is one such character."""
    low = c.lower()
    return (
        unicodedata.category(c)[0] in "LNPS" and len(low) == 1 and c != "Σ" and unicodedata.normalize("NFC", c + low) == c + low
        and any(lo <= ord(low) < hi for lo, hi in _BLOCKS)
    )


PLAIN = [c for lo, hi in _BLOCKS for c in map(chr, range(lo, hi)) if _plain(c)]


def _ranges(chars: list[str]) -> str:
    """The inside of a bracket expression of some characters in order, by ranges."""
    codes = np.array([ord(c) for c in chars])
    first = np.flatnonzero(np.diff(codes, prepend=-9) != 1)
    last = np.append(first[1:], len(codes)) - 1
    return "".join(f"{re.escape(chars[a])}-{re.escape(chars[b])}" for a, b in zip(first, last))


_L, _N = (_ranges([c for c in PLAIN if unicodedata.category(c)[0] == kind]) for kind in "LN")
# The splitter's pattern over words of plain characters with a blank between them; the blank is a piece of its own.
_PIECE = re.compile(rf" |'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ {_L}{_N}]+")


@lru_cache(maxsize=1)
def piece_ranks(vocabulary: str) -> tuple[dict[bytes, int], np.ndarray, str] | None:
    """Byte pair ranks that code a piece with _LAST behind it, the id of each rank, and a pattern of words left to the tokenizer.

    The end of a piece is merged into its last byte first. Ranks then give the tokenizer's ids if every token is what
    its own bytes are merged to: wherever two neighbours together make a token, they are the pair it is merged from.
    None for a tokenizer of which this is not known.
    """
    given = json.loads(vocabulary)
    model, suffix = given["model"], given["model"].get("end_of_word_suffix")
    added = given.get("added_tokens") or []
    if (
        any(model.get(k) != v for k, v in _MODEL.items()) or not suffix or given.get("normalizer") != _NORMALIZER
        or given.get("pre_tokenizer") != _SPLITTER or given.get("truncation") or given.get("padding")
        or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added)
    ):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]   # the others are written as characters from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    tokens = [*(c + suffix for c in byte), *byte, *(a + b for a, b in merges)]
    order = {pair: i for i, pair in enumerate(merges)}
    if len(set(tokens)) < len(tokens) or len(order) < len(merges) or not vocab.keys() >= set(tokens):
        return None

    def own(token: str) -> bool:
        parts = list(token.removesuffix(suffix))
        if token.endswith(suffix):
            parts[-1] += suffix
        while len(parts) > 1:
            rank, i = min((order.get(pair, len(merges)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(merges):
                return False
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return True

    def raw(token: str) -> bytes:
        return bytes(byte[c] for c in token.removesuffix(suffix)) + (_LAST if token.endswith(suffix) else b"")

    if not all(map(own, tokens)):
        return None
    ranks = {raw(t): i for i, t in enumerate(tokens)}
    if len(ranks) < len(tokens):
        return None
    ranks[_LAST] = len(tokens)   # only for the library, which wants all single bytes
    odd = "|".join([rf"[^{_ranges(PLAIN)}]", *(re.escape(t["content"]) for t in added)])
    return ranks, np.array([vocab[t] for t in tokens], dtype=ID), odd


class Pieces(dict):
    """Ranks of a piece's tokens as native unsigned 32-bit numbers; a blank stands for the end of a word."""

    def __init__(self, ranks: dict[bytes, int]):
        self.code = tiktoken.Encoding("pieces", pat_str=" ", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.blank = len(ranks)

    def __missing__(self, piece: str) -> bytes:
        codes = [self.blank] if piece == " " else self.code(piece.encode() + _LAST)
        got = self[piece] = array("I", codes).tobytes()
        return got


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit numbers, by the tokenizer.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its words in order. Words of
    plain characters are cut and coded here, each distinct word of some texts once; the others are coded by the
    tokenizer and kept: when KEPT_WORDS are known, only those used since stay.
    """

    def __init__(self, vocabulary: str, ranks: tuple[dict[bytes, int], np.ndarray, str] | None = None):
        # One task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.vocabulary, self.older = vocabulary, {}
        self.ranks = ranks or piece_ranks(vocabulary)
        if self.ranks:
            self.pieces = Pieces(self.ranks[0])

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.vocabulary)

    def encode(self, texts: Sequence[bytes | None] | pa.Array) -> list[bytes]:
        """Ids of whole texts, end to end; nothing for a null text."""
        of, found = split_at_space(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        if not len(found):
            return [b""] * len(texts)
        coded = found.dictionary_encode()
        ids, sizes = self._coded(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
        flat = lists.take(coded.indices).flatten().to_numpy(zero_copy_only=False).tobytes()
        ends = np.cumsum(np.bincount(of, sizes[code], len(texts)).astype(np.int64)) * ID.itemsize
        return [flat[lo:hi] for lo, hi in zip([0, *ends.tolist()], ends.tolist())]

    def _coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and their number of each."""
        if not self.ranks:
            return self._by_tokenizer(words)
        _, of_rank, odd = self.ranks
        left = pc.match_substring_regex(words, odd)
        left_at = np.flatnonzero(left.to_numpy(zero_copy_only=False))
        if len(left_at) == len(words):
            return self._by_tokenizer(words)
        pieces, blank = self.pieces, self.pieces.blank
        if len(pieces) > KEPT_PIECES:
            pieces.clear()
        plain = words.filter(pc.invert(left)) if len(left_at) else words
        one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()
        ranks = np.frombuffer(b"".join(map(pieces.__getitem__, _PIECE.findall(one.lower() + " "))), dtype=np.uint32)
        ends = np.flatnonzero(ranks == blank)
        ids, sizes = of_rank[np.delete(ranks, ends)], np.diff(ends, prepend=-1) - 1
        if not len(left_at):
            return ids, sizes
        more, many = self._by_tokenizer(words.filter(left))
        # Words by place, though those of the tokenizer come last.
        place = np.argsort(np.append(np.flatnonzero(~left.to_numpy(zero_copy_only=False)), left_at))
        both, size = np.concatenate((ids, more)), np.concatenate((sizes, many))
        first = (np.cumsum(size) - size)[place]
        size = size[place]
        return both[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def _by_tokenizer(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        wanted = words.cast(pa.binary()).to_pylist()
        new = set(wanted).difference(self)
        self.update((w, self.older[w]) for w in new.intersection(self.older))
        fresh = list(new.difference(self.older))
        for lo in range(0, len(fresh), WORDS_AT_ONCE):
            self._learn(fresh[lo:lo + WORDS_AT_ONCE])
        got = [self[w] for w in wanted]
        return np.frombuffer(b"".join(got), dtype=ID), np.array([len(g) // ID.itemsize for g in got], dtype=np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Many words as one text; a token belongs to the word in which it starts."""
        texts = [w.decode() for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, dtype=ID).tobytes()
        at = np.fromiter(map(itemgetter(0), found.offsets), np.int64, len(found.ids))
        cuts = np.searchsorted(at, np.cumsum([0] + [len(t) + 1 for t in texts])) * ID.itemsize
        self.update((w, ids[lo:hi]) for w, lo, hi in zip(words, cuts.tolist(), cuts[1:].tolist()))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(vocabulary: str, ranks: tuple[dict[bytes, int], np.ndarray, str] | None = None) -> WordIds:
    """One for all tasks of a worker: what codes words is built once, and words known stay known."""
    if vocabulary not in _WORD_IDS:
        _WORD_IDS.clear()
        _WORD_IDS[vocabulary] = WordIds(vocabulary, ranks)
    return _WORD_IDS[vocabulary]


class Piece(NamedTuple):
    row: int      # place of the document in the task
    start: int    # its ids before the piece
    ids: memoryview

    @property
    def length(self) -> int:
        return len(self.ids) // ID.itemsize

    def cut(self, n: int) -> tuple[Piece, Piece]:
        at = n * ID.itemsize
        return Piece(self.row, self.start, self.ids[:at]), Piece(self.row, self.start + n, self.ids[at:])


class _Stock:
    """Pieces by length; the longest not above a limit in logarithmic time."""

    def __init__(self, longest: int):
        self.stacks: list[list[Piece]] = [[] for _ in range(longest + 1)]
        self.lengths: list[int] = []

    def put(self, piece: Piece) -> None:
        n = piece.length
        if not self.stacks[n]:
            self.lengths.insert(bisect_left(self.lengths, n), n)
        self.stacks[n].append(piece)

    def take(self, limit: int) -> Piece | None:
        k = bisect_right(self.lengths, limit) - 1
        if k < 0:
            return None
        n = self.lengths[k]
        piece = self.stacks[n].pop()
        if not self.stacks[n]:
            del self.lengths[k]
        return piece


class Packer:
    """Packs the documents of one task, pool by pool; what fills no window or group waits for the next pool."""

    def __init__(self, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step = sorted(tiers), step_tokens
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.pool: list[Piece] = []
        self.waiting: dict[int, list[list[Piece]]] = {}
        self.tokens = self.sequences = self.groups = 0

    def add(self, row: int, ids: bytes) -> None:
        """A document: its full windows are sequences at once, the rest goes to the pool."""
        longest, view = self.tiers[-1], memoryview(ids)
        rest = Piece(row, 0, view)
        while rest.length >= longest:
            window, rest = rest.cut(longest)
            self._done(longest, [window])
        if rest.length:
            self.pool.append(rest)
        self.tokens += len(ids) // ID.itemsize

    def _done(self, tier: int, pieces: list[Piece]) -> None:
        self.waiting.setdefault(tier, []).append(pieces)

    def flush(self, last: bool = False) -> list[tuple]:
        """Rows (row, start, ids, sequence, offset, tier, step group) of all groups that are full, or of all."""
        stock = _Stock(self.tiers[-1])
        for piece in self.pool:
            stock.put(piece)
        self.pool, self.tokens = [], 0
        for tier, below in reversed(list(zip(self.tiers, [0, *self.tiers]))):
            # Documents above the next shorter tier open this tier's windows.
            while stock.lengths and stock.lengths[-1] > below:
                pieces, full = self._window(stock, tier)
                if full:
                    self._done(tier, pieces)
                else:  # nothing is left to fill it with
                    self.pool = pieces
        if last and self.pool:
            self._leftover()
        return [row for tier in list(self.waiting) for row in self._dealt(tier, last)]

    def _window(self, stock: _Stock, tier: int) -> tuple[list[Piece], bool]:
        pieces, gap = [], tier
        while gap:
            piece = stock.take(gap)
            if piece is None:
                piece = stock.take(self.tiers[-1])
                if piece is None:
                    return pieces, False
                piece, rest = piece.cut(gap)
                stock.put(rest)
            pieces.append(piece)
            gap -= piece.length
        return pieces, True

    def _leftover(self) -> None:
        """The task's last window, cut at powers of two: no sequence needs padding."""
        rest, total = self.pool, sum(p.length for p in self.pool)
        self.pool = []
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                pieces, gap = [], 1 << bit
                while gap:
                    piece = rest.pop(0)
                    if piece.length > gap:
                        piece, after = piece.cut(gap)
                        rest.insert(0, after)
                    pieces.append(piece)
                    gap -= piece.length
                self._done(1 << bit, pieces)

    def _dealt(self, tier: int, last: bool) -> Iterator[tuple]:
        """Sequences of a tier by falling attention cost, dealt to and fro over the groups."""
        size = max(1, self.step // tier)
        ready = sorted(self.waiting[tier], key=lambda pieces: -sum(p.length ** 2 for p in pieces))
        n = len(ready) // size
        # A group that is not full waits; the last one of a task may be smaller.
        self.waiting[tier] = [] if last else ready[n * size:]
        if last:
            n += len(ready) > n * size
        else:
            ready = ready[:n * size]
        for k, pieces in enumerate(ready):
            turn, place = divmod(k, n)
            group = self.groups + (place if turn % 2 == 0 else n - 1 - place)
            offset = 0
            for piece in pieces:
                yield piece.row, piece.start, piece.ids, self.sequences, offset, tier, group
                offset += piece.length
            self.sequences += 1
        self.groups += n


def ids_column(ids: Sequence[memoryview]) -> pa.Array:
    """Pieces' ids as one binary column; Arrow would never let go of memoryviews that it converts itself."""
    ends = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int64), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, ends.buffers()[1], pa.py_buffer(b"".join(ids))])


def pack(
    df: DataFrame, key: str, text: str, vocabulary: str, end: int, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS
) -> DataFrame:
    """(key, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group) of every piece.

    `vocabulary` is the path of a tokenizer file, read here and sent with the tasks; `end` follows every document.
    `ids` holds little-endian unsigned 32-bit numbers. A null or empty text is the end id alone; rows that repeat a
    key or a text are documents of their own; a null key stays null; an empty table gives no rows. Only `key` and
    `text` are read, so other columns cannot clash.

    Each task packs the documents it reads: no shuffle, no key decides where a row goes, and memory is bounded by a
    pool and the longest document. Sequence and group numbers start at the task's number times 2**33. Every sequence
    has a power of two as length, hence no padding; a task's last window is cut at powers of two below its tier.
    """
    with open(vocabulary, encoding="utf-8") as f:
        words = f.read()
    ranks = piece_ranks(words)
    key_type = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    end_id = np.array([end], dtype=ID).tobytes()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = word_ids(words, ranks), Packer(tiers, step_tokens)
        base = TaskContext.get().partitionId() << 33
        keys: dict[int, tuple] = {}   # documents not given in full: key, tokens, tokens given
        n = 0

        def rows(last: bool) -> pa.RecordBatch | None:
            out = packer.flush(last)
            if not out:
                return None
            row, start, ids, sequence, offset, tier, group = zip(*out)
            length = [len(i) // ID.itemsize for i in ids]
            owner = [keys[k][:2] for k in row]
            for k, size in zip(row, length):
                key_value, total, given = keys[k]
                if given + size == total:
                    del keys[k]
                else:
                    keys[k] = key_value, total, given + size
            return pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in owner], key_arrow), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                ids_column(ids), pa.array([t for _, t in owner], pa.int64()),
                pa.array([base + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()), pa.array(tier, pa.int32()),
                pa.array([base + g for g in group], pa.int64()),
            ], ["k", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        key_arrow = None
        for batch in batches:
            key_arrow = batch.column(0).type
            for part in byte_groups(batch, 1, GROUP_BYTES):
                for value, ids in zip(part.column(0).to_pylist(), known.encode(part.column(1))):
                    ids += end_id
                    keys[n] = value, len(ids) // ID.itemsize, 0
                    packer.add(n, ids)
                    n += 1
                    if packer.tokens >= POOL_TOKENS:
                        made = rows(False)
                        if made is not None:
                            yield made
        made = rows(True)
        if made is not None:
            yield made

    schema = (
        f"k {key_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    )
    return narrow.mapInArrow(tasks, schema).select(
        F.col("k").alias(key), "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "tier", "step_group",
    )
