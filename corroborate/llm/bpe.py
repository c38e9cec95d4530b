"""Byte-level BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of each distinct word (one automaton over all new words). A sequence of
tokens is the one that merging gives exactly when every two neighbours, merged on their own, stay these two
tokens. That is read off the rules, for all distinct pairs of neighbours at once: going back from the finished
tokens in order of rank, the two tokens that face each other across the boundary at any time must have no rule that
would have fired before either was merged into its own token. Only words with a failing pair are merged exactly,
all together, one rule a word and step.

This reading needs rules that build on earlier ones only, and one rule a token, as training gives; with any other
vocabulary every word is merged exactly.

Cases: null counts as empty and gives no token; the vocabulary's special strings inside a text become their
own ids; long texts are taken in pieces of about CHUNK characters, cut before a space between a sign and a letter,
where a new word begins whatever comes before; a word longer than LONGEST_CACHED bytes is merged on its own; other
columns are never looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corroborate.session import ship

RESULT = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,exact:boolean>"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _latin() -> re.Pattern:
    """WORDS for texts of Latin-1 signs only, with its classes written out: the plainer engine is twice as fast."""
    letter, number, space = ("".join(re.escape(chr(c)) for c in range(256) if regex.match(p, chr(c))) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


LATIN = _latin()
CUT = regex.compile(r"(?<=\S) (?=\p{L})")
CACHED_WORDS = 200_000
LONGEST_CACHED = 64
CHUNK = 1 << 20
NEVER = 1 << 30
GAP = "\u0100"


def words_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WORDS.findall(text)
    return LATIN.findall(text)


def byte_signs() -> dict[str, int]:
    """The printable sign that such vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        signs = byte_signs()
        raw = lambda token: bytes(signs[c] for c in token)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, rule in enumerate(merges):
            a, b = (raw(x) for x in (rule if isinstance(rule, list) else rule.split(" ")))
            self.rules[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.failed = 0
        self._tables()

    def _tables(self) -> None:
        """The rules as arrays: sorted pair codes with their ranks; per rank the token made; per token the rank that makes it and its two parts."""
        n = len(self.tokens)
        found = np.array([(a, b, r, c) for (a, b), (r, c) in self.rules.items()], np.int64).reshape(-1, 4)
        code = found[:, 0] << 32 | found[:, 1]
        order = np.argsort(code)
        self.code, self.rank = np.append(code[order], np.iinfo(np.int64).max), np.append(found[order, 2], NEVER)
        self.made = np.full(int(found[:, 2].max(initial=0)) + 1, -1)
        self.made[found[:, 2]] = found[:, 3]
        self.born, self.left, self.right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.born[found[:, 3]], self.left[found[:, 3]], self.right[found[:, 3]] = found[:, 2], found[:, 0], found[:, 1]
        self.size = np.array([len(t) for t in self.tokens])
        self.layered = len(set(found[:, 3].tolist())) == len(found) and bool((np.maximum(self.born[found[:, 0]], self.born[found[:, 1]]) < found[:, 2]).all())
        # tokens that their own merging gives back: their parts do, and nothing fires across the parts before they meet
        whole = np.array([t in self.ids for t in self.tokens]) & ((self.size == 1) | (self.born >= 0))
        made = found[:, 3]
        if self.layered:
            whole[made] &= ~self._fires(found[:, 0], found[:, 1], found[:, 2])
            for a, b, _, c in found[np.argsort(found[:, 2])].tolist():
                whole[c] &= whole[a] & whole[b]
        self.whole = whole & self.layered
        self.machine = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.machine.add_word(t.decode("latin-1"), i)
        self.machine.make_automaton()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's rule, or NEVER."""
        code = a << 32 | b
        at = np.searchsorted(self.code, code)
        return np.where(self.code[at] == code, self.rank[at], NEVER)

    def _fires(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Does a rule fire across the boundary of tokens a and b before they are whole, or before rank until?"""
        x, y, at = a.copy(), b.copy(), np.arange(len(a))
        end_x = np.full(len(a), NEVER) if until is None else until.copy()
        end_y = end_x.copy()
        out = np.zeros(len(a), bool)
        while len(at):
            r = self._rank(x, y)
            hit = (r < end_x) & (r <= end_y) & (r < NEVER)  # of equal pairs in a row the left one goes first
            out[at[hit]] = True
            on = ~hit & ((self.born[x] >= 0) | (self.born[y] >= 0))
            x, y, end_x, end_y, at = x[on], y[on], end_x[on], end_y[on], at[on]
            back = self.born[x] > self.born[y]  # the later made is undone first; of equals the right one, as the left was made first
            end_x, end_y = np.where(back, self.born[x], end_x), np.where(back, end_y, self.born[y])
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one word."""
        return self.merge_long(self.single[np.frombuffer(word, np.uint8)].tolist())

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of words of at most LONGEST_CACHED bytes: in each step every word not yet done fires its lowest rule, leftmost among equals."""
        out: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), 8192):
            part = order[at : at + 8192]
            wide = int(length[part[-1]])
            ids = self.single[np.frombuffer(b"".join([words[i].ljust(wide, b"\0") for i in part.tolist()]), np.uint8).reshape(-1, wide)]
            ids[np.arange(wide) >= length[part][:, None]] = -1
            rank = self._rank(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0))
            rank[ids[:, 1:] < 0] = NEVER
            while len(part):
                rows = np.arange(len(part))
                j = rank.argmin(1) if rank.shape[1] else np.zeros(len(part), np.int64)
                best = rank[rows, j] if rank.shape[1] else np.full(len(part), NEVER)
                done = best == NEVER
                for i, row, n in zip(part[done].tolist(), ids[done].astype("<u4"), (ids[done] >= 0).sum(1).tolist(), strict=True):
                    out[i] = row[:n].tobytes()
                on = ~done
                part, ids, rank, j, best = part[on], ids[on], rank[on], j[on], best[on]
                if not len(part):
                    break
                rows, cols = np.arange(len(part)), np.arange(ids.shape[1] - 1)
                ids[rows, j] = self.made[best]
                ids = np.take_along_axis(ids, cols + (cols > j[:, None]), 1)
                rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] >= j[:, None]), 1)
                for side in (j - 1, j):
                    ok = (side >= 0) & (side < rank.shape[1])
                    r, k = rows[ok], side[ok]
                    b = ids[r, k + 1]
                    rank[r, k] = np.where(b < 0, NEVER, self._rank(ids[r, k], np.maximum(b, 0)))
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, so that a word of n bytes costs n log n."""
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rules.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [t for t, on in zip(ids, alive, strict=True) if on]

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """For codes a<<32|b of neighbours: does merging them on their own give them back?"""
        distinct, back = np.unique(codes, return_inverse=True)
        a, b = distinct >> 32, distinct & 0xFFFFFFFF
        good = self.whole[a] & self.whole[b]
        good[good] = ~self._fires(a[good], b[good])
        return good[back]

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left: the tokens of all words in a row, and where each word's tokens end."""
        text = GAP.join([w.decode("latin-1") for w in words])
        flat = np.fromiter(map(itemgetter(1), self.machine.iter_long(text)), np.int64)
        upto = np.cumsum(self.size[flat])
        ends = np.searchsorted(upto, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))) + 1
        return flat, ends

    def learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Token ids, as little-endian 32-bit integers, of words."""
        coded = {w: w.encode() for w in fresh}
        told = {w: np.array(self.merge(b), "<u4").tobytes() for w, b in coded.items() if len(b) > LONGEST_CACHED}
        rest = [w for w in fresh if w not in told]
        raw = [coded[w] for w in rest]
        if not raw:
            return told
        flat, ends = self.greedy(raw)
        begins = np.append(0, ends[:-1])
        good = self.whole[flat]
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        pair = np.flatnonzero(inner)
        good[pair] &= self.compatible(flat[pair] << 32 | flat[pair + 1])
        fits = np.logical_and.reduceat(good, begins)
        ids = flat.astype("<u4").tobytes()
        told.update({w: ids[4 * a : 4 * b] for w, a, b in zip(rest, begins.tolist(), ends.tolist(), strict=True)})
        bad = np.flatnonzero(~fits).tolist()
        told.update(zip([rest[i] for i in bad], self.merge_many([raw[i] for i in bad]), strict=True))
        self.failed += len(bad)
        return told

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces that are encoded apart: special strings, and runs between them of about CHUNK characters."""
        for part in self.split.split(text) if self.split else [text]:
            at = 0
            while len(part) - at > 2 * CHUNK and (m := CUT.search(part, at + CHUNK)):
                yield part[at : m.start()]
                at = m.start()
            if part:
                yield part[at:]

    def encode_batch(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """Of each text its ids, piece by piece, as little-endian unsigned 32-bit integers. Short texts are taken together, so that their new words are tested together."""
        for group in _together(texts):
            held = [list(self.pieces(t)) for t in group]
            if len(group) == 1:
                yield (self._ids([p])[0] for p in held[0])
                continue
            flat = iter(self._ids([p for pieces in held for p in pieces]))
            yield from (iter([next(flat) for _ in pieces]) for pieces in held)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        told = self.words
        words = [[] if p in self.special else words_of(p) for p in pieces]
        fresh = list({w for x in words for w in x}.difference(told))
        if fresh:
            told.update(self.learn(fresh))
        out = [np.array([self.special[p]], "<u4").tobytes() if p in self.special else b"".join(map(told.__getitem__, x)) for p, x in zip(pieces, words, strict=True)]
        for w in fresh:
            if len(w.encode()) > LONGEST_CACHED:
                del told[w]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(next(iter(self.encode_batch([text]))))

    def decode(self, ids: bytes) -> str:
        return "".join(self.decode_pieces([ids]))

    def decode_pieces(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """The text of ids that come piece by piece; a sign may be cut between two pieces."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in pieces:
            yield reader.decode(b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())))
        yield reader.decode(b"", True)


def _together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of about CHUNK characters; one that is cut in pieces is a group of its own."""
    held, room = [], CHUNK
    for t in texts:
        if held and (len(t) > room or len(t) > 2 * CHUNK):
            yield held
            held, room = [], CHUNK
        held.append(t)
        room -= len(t)
    if held:
        yield held


@lru_cache(4)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(Path(path).read_bytes())


@lru_cache(4)
def _built(content: bytes) -> ByteBpe:
    return ByteBpe(content)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shipped(spark: SparkSession, path: str | None):
    """The vocabulary file at path, which only the driver needs to see, as a broadcast of its content."""
    ship(spark)
    return spark.sparkContext.broadcast(Path(path or default_path()).read_bytes())


def digests(spark: SparkSession, path: str | None = None):
    """A column function text -> struct(n_tokens, ids_sha256, decoded_sha256, exact: decoding gave the text back)."""
    held = _shipped(spark, path)

    @F.arrow_udf(RESULT)
    def coded(text: pa.Array) -> pa.Array:
        bpe, rows = _built(held.value), []
        texts = [x or "" for x in text.to_pylist()]
        for t, pieces in zip(texts, bpe.encode_batch(texts), strict=True):
            n, ids_sha, text_sha, own_sha = 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256(t.encode())

            def seen(ids: bytes) -> bytes:
                nonlocal n
                n += len(ids) // 4
                ids_sha.update(ids)  # noqa: B023
                return ids

            for part in bpe.decode_pieces(map(seen, pieces)):
                text_sha.update(part.encode())
            rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest(), text_sha.digest() == own_sha.digest()))
        n, one, two, same = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(same, pa.bool_())], ["n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return coded


def encoder(spark: SparkSession, path: str | None = None):
    """A column function text -> array of token ids."""
    held = _shipped(spark, path)

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        bpe = _built(held.value)
        return pa.array([np.frombuffer(b"".join(x), "<i4") for x in bpe.encode_batch([x or "" for x in text.to_pylist()])], pa.list_(pa.int32()))

    return ids


def decoder(spark: SparkSession, path: str | None = None):
    """A column function array of token ids -> text."""
    held = _shipped(spark, path)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        bpe = _built(held.value)
        return pa.array([bpe.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in ids], pa.string())

    return text
