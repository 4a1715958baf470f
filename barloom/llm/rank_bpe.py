"""Byte-level BPE by contiguous rank arrays.

Each short word holds its parts and the ranks of adjacent pairs in one row of an array. The lowest rank is found by a
scan, its right part is deleted by moving the rest left, and the two ranks beside it are looked up anew, until no pair has
a rank. Many words go through these steps side by side. Words of over LONG bytes use a heap over linked parts, which gives
the same ids.

Null texts count as empty: no ids, empty decoded text. A special token's string in a text is that token, as in the
tokenizers library. Further columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import IdCache, as_large, bounds_of, local, release, shipped, slices, small_batches, spread

LONG = 96
NONE = np.int32(2**31 - 1)
#: Fixed value: the pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space beside white space: the only place where a cut before a space could change the split.
DOUBLE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]{2}"


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class RankBpe:
    """Encoder and decoder of a byte-level BPE file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(local(path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.of_byte = np.array([vocab[c] for c in chars], np.int32)
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = np.append(pairs[order], np.int64(2**62)), np.append(order, NONE).astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rank_of = {int(p): r for r, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        byte_of = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for token, i in vocab.items():
            strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            strings[i] = token.encode()
        self.lens = np.fromiter(map(len, strings), np.int64, size)
        self.starts, self.bytes = np.cumsum(self.lens) - self.lens, np.frombuffer(b"".join(strings), np.uint8)
        self.chunks = IdCache(self.ids_of_chunks)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no merge or a part is missing (below 0)."""
        key = (left.astype(np.int64) << 20) | right
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def short_words(self, words: list[bytes]) -> np.ndarray:
        """Ids of words of up to LONG bytes, side by side: a row for each, filled up with -1."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        width = int(n.max()) + 1
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        parts = np.full((len(words), width), -1, np.int32)
        parts[np.repeat(np.arange(len(words)), n), spread(np.zeros(len(n), np.int64), n)] = flat
        ranks = np.full((len(words), width), NONE, np.int32)
        ranks[:, :-1] = self.look_up(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), width - 1)
        out = np.full((len(words), width), -1, np.int32)
        row, cols = np.arange(len(words)), np.arange(width)
        while len(row):
            low = ranks.argmin(axis=1)
            some = np.arange(len(row))
            live = ranks[some, low] != NONE
            out[row[~live]] = parts[~live]
            row, parts, ranks, low = row[live], parts[live], ranks[live], low[live]
            if not len(row):
                break
            some = np.arange(len(row))
            parts[some, low] = self.merged[ranks[some, low]]
            moved = np.minimum(cols + (cols > low[:, None]), width - 1)
            parts = np.take_along_axis(parts, moved, 1)
            moved_ranks = np.minimum(cols + (cols >= low[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, moved_ranks, 1)
            parts[:, -1], ranks[:, -1] = -1, NONE
            right = np.minimum(low + 1, width - 1)
            ranks[some, low] = self.look_up(parts[some, low], parts[some, right])
            left = low > 0
            before = low[left] - 1
            ranks[some[left], before] = self.look_up(parts[some[left], before], parts[some[left], low[left]])
        return out

    def long_word(self, word: bytes) -> list[int]:
        """Ids of one long word by a heap of (rank, place) over linked parts."""
        parts = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = lambda i, j: self.rank_of.get((parts[i] << 20) | parts[j])
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (s := rank(i, after[i])) is not None:
                    heapq.heappush(heap, (s, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (s := rank(before[i], i)) is not None:
                heapq.heappush(heap, (s, before[i], parts[before[i]], parts[i]))
        return [p for p in parts if p >= 0]

    def ids_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the pattern has split off, and the number of each word's."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, lens, places = [], np.zeros(len(words), np.int64), []
        kind = np.where(sizes > LONG, -1, np.ceil(sizes / 6).astype(np.int64))
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            for j in range(0, len(at), 16384):
                some = at[j : j + 16384]
                if k < 0:
                    lists = [self.long_word(words[i]) for i in some]
                    ids += [np.array(x, np.int32) for x in lists]
                    lens[some] = [len(x) for x in lists]
                else:
                    rows = self.short_words([words[i] for i in some])
                    ids.append(rows[rows >= 0])
                    lens[some] = (rows >= 0).sum(axis=1)
                places.append(some)
        if not places:
            return np.zeros(0, np.int32), lens
        flat, order = np.concatenate(ids), np.concatenate(places)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return flat[spread(starts, lens)], lens

    def ids_of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, most of which are one word of letters with a space before it or none."""
        find = self.split.findall
        lists = [(c,) if c.isalpha() or c[:1] == " " and c[1:].isalpha() else find(c) for c in chunks]
        distinct = dict.fromkeys(p for pieces in lists for p in pieces)
        for i, p in enumerate(distinct):
            distinct[p] = i
        flat, lens = self.ids_of_words([p.encode() for p in distinct])
        at = np.fromiter((distinct[p] for pieces in lists for p in pieces), np.int64)
        own = lens[at]
        total = bounds_of(own)[bounds_of(np.fromiter(map(len, lists), np.int64, len(lists)))]
        return flat[spread((np.cumsum(lens) - lens)[at], own)], np.diff(total)

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text, special tokens' strings included, without the short cut by chunks."""
        parts, last = [], 0
        for m in [*self.cut.finditer(text), None]:
            pieces = self.split.findall(text[last : m.start() if m else len(text)])
            distinct = list(dict.fromkeys(pieces))
            at = dict(zip(distinct, self.chunks.places(pa.array(distinct, pa.large_string())).tolist(), strict=True))
            places = np.fromiter((at[p] for p in pieces), np.int64, len(pieces))
            parts.append(self.chunks.gather(places, np.array([0, len(places)]))[0])
            if m:
                parts.append(np.array([self.special[m[0]]], np.int32))
                last = m.end()
        return np.concatenate(parts).astype(np.int32)

    def encode(self, texts: pa.Array, slice_bytes: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each text's ids.

        A text is cut before each space, around line ends and between a letter and a full stop or comma; where no white
        space stands beside white space, no piece of the pattern spans such a cut. Other texts, and those with a NUL or
        "<|", are split whole.
        """
        parts, lens = [], []
        for some in slices(as_large(texts), slice_bytes):
            odd = pc.or_(pc.match_substring_regex(some, DOUBLE), pc.or_(pc.match_substring(some, "\0"), pc.match_substring(some, "<|")))
            plain = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", some), " ", "\0 "), "\n", "\0\n\0")
            chunks = pc.split_pattern(pc.replace_substring_regex(plain, r"(\pL)([.,])", "\\1\0\\2"), "\0")
            first = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
            coded = chunks.flatten().dictionary_encode()
            flat, bounds = self.chunks.gather(self.chunks.places(coded.dictionary)[coded.indices.to_numpy()], first)
            own = np.diff(bounds)
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            if len(at):
                lists = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                for i in at:
                    lists[i] = self.whole(some[int(i)].as_py())
                    own[i] = len(lists[i])
                flat = np.concatenate(lists)
            parts.append(flat.astype(np.int32, copy=False))
            lens.append(own)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), bounds_of(np.concatenate(lens) if lens else [])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts of ids as UTF-8; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = ids[a:b]
            raw = self.bytes[spread(self.starts[own], self.lens[own])].tobytes()
            out.append(raw if _valid(raw) else raw.decode("utf-8", "replace").encode())
        return out


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(2)
def coder(path: str) -> RankBpe:
    return RankBpe(path)


@contextlib.contextmanager
def held(path: str):
    """A coder for one task; its vocabulary and cached words go when the task ends."""
    try:
        yield coder(path)
    finally:
        coder.cache_clear()
        release()


def bpe_ids(text: Column, path: str) -> Column:
    """array<int> of a text's ids; executors that don't see path need it sent by shipped()."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with held(path) as bpe:
            for texts in batches:
                ids, bounds = bpe.encode(texts)
                yield pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))

    return encoded(text)


def bpe_text(ids: Column, path: str) -> Column:
    """The text that ids stand for."""

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        bounds = lists.offsets.to_numpy().astype(np.int64)
        return pa.array(coder(path).decode(lists.values.to_numpy(zero_copy_only=False), bounds)).cast(pa.string())

    return decoded(F.coalesce(ids, F.array().cast("array<int>")))


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded in one pass."""
    small_batches(docs.sparkSession)
    shipped(docs.sparkSession, path)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with held(path) as bpe:
            for texts in batches:
                n, of_ids, of_text = [np.zeros(0, np.int64)], [], []
                for some in slices(as_large(texts), 4 << 20):
                    ids, bounds = bpe.encode(some)
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    n.append(np.diff(bounds))
                    of_ids += [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
                    of_text += [hashlib.sha256(t).hexdigest() for t in bpe.decode(ids, bounds)]
                yield pa.StructArray.from_arrays([pa.array(np.concatenate(n), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col)).alias("d"))
    return rows.select("doc_id", "d.*")
