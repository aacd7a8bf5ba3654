"""BPE encoding and decoding that speculates and verifies.

Each distinct word gets tokens by greedy longest match. Such a proposal is what exact merging gives if, and only if,
no pair of neighbours in it would have merged across their border; that test is one vectorised pass over the distinct
pairs of a batch. Only words with a failing pair are merged exactly. Whatever a word gives is kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready_for_python

#: Fixed values of the vocabulary file's format: its end-of-word mark, and the one character that stands for it here.
END, END_MARK = "</w>", "\n"
#: Fixed values of the vocabulary file's normalizer and pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Words kept with their tokens in each Python worker; beyond that the cache starts anew, with the words of the one before
#: that are met again.
CACHE_WORDS = 75_000
#: Words longer than this aren't kept.
CACHE_LENGTH = 64
#: Texts of so many characters are put together from one pass over their new words.
TOGETHER = 2_000_000
NEVER = np.int64(1) << 40
#: What `str.split` takes for white space and the vocabulary file doesn't.
SPLIT_TOO = "\x1c\x1d\x1e\x1f"
#: Packs so many tokens into bytes.
PACKED = [struct.Struct(f"<{n}I").pack for n in range(10)]


def byte_chars() -> str:
    """The printable character that byte-level vocabularies use for each of the 256 bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in set(shown) else next(rest)) for b in range(256))


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file with word ends, and what verification needs of them.

    The ids of merged tokens must follow the order of the merges, as they do in files of this kind; this is checked.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        short = lambda t: t.removesuffix(END) + END_MARK if t.endswith(END) else t
        self.ids: dict[str, int] = {short(t): i for t, i in model["vocab"].items()}
        self.text: list[str] = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.text[i] = t
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.full(len(self.text), -1, np.int64)
        self.right = self.left.copy()
        self.merge: dict[tuple[int, int], int] = {}
        last = -1
        for a, b in merges:
            x, y, z = self.ids[short(a)], self.ids[short(b)], self.ids[short(a + b)]
            if z <= max(last, x, y):
                raise ValueError("ids of merged tokens don't follow the order of the merges")
            self.merge[x, y] = last = z
            self.left[z], self.right[z] = x, y
        keys = np.array([x * len(self.text) + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(self.merge.values()), np.int64)[order]
        #: What greedy matching may propose: tokens that merging their own characters gives back.
        self.reachable = {t: i for t, i in self.ids.items() if self.merged(t) == [i]}
        lengths: dict[str, set[int]] = {}
        for t in self.reachable:
            lengths.setdefault(t[:3], {1, 2}).add(len(t))
        #: The lengths of such tokens by their first three characters, the longest first.
        self.lengths = {start: tuple(sorted(found, reverse=True)) for start, found in lengths.items()}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("special_pattern", "split_pattern")}

    @cached_property
    def special_pattern(self):
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def split_pattern(self):
        return regex.compile(SPLIT)

    def merged(self, word: str) -> list[int]:
        """Exact merging: the pair with the lowest rank first, the leftmost among equals."""
        parts = [c + END_MARK if word[k + 1 : k + 2] == END_MARK else c for k, c in enumerate(word) if c != END_MARK]
        ids = [self.ids[p] for p in parts]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        queue = [(z, k) for k in range(len(ids) - 1) if (z := self.merge.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            z, k = heapq.heappop(queue)
            n = after[k]
            if ids[k] < 0 or n < 0 or self.merge.get((ids[k], ids[n])) != z:
                continue
            ids[k], ids[n], after[k] = z, -1, after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (made := self.merge.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(queue, (made, a))
        return [i for i in ids if i >= 0]

    def proposed(self, word: str) -> list[int] | None:
        """Greedy longest match; None where it would leave a word's end without a character."""
        out, at, n, find, lengths = [], 0, len(word), self.reachable.get, self.lengths.get
        while at < n:
            for length in lengths(word[at : at + 3], (2, 1)):
                end = at + length
                if end != n - 1 and (i := find(word[at:end])) is not None:
                    break
            else:
                return None
            out.append(i)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours, whether no merge crosses their border.

        The two pieces that meet at the border are followed back through time: of the two, the one that was formed
        later (the right one, if both are one token) is split. A merge of the two pieces would have come first if its
        rank is under that of the left piece's own merge and not over that of the right piece's.
        """
        a, b, v = a.astype(np.int64), b.astype(np.int64), len(self.text)
        into_a, into_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            made = self.made_of(x * v + y)
            bad = (made < into_a[live]) & (made <= into_b[live])
            good[live[bad]] = False
            split_a, split_b = self.left[x] >= 0, self.left[y] >= 0
            back_a = split_a & ((x > y) | ~split_b)
            back_b = split_b & ~back_a
            i, j = live[back_a], live[back_b]
            into_a[i], a[i] = a[i], self.right[a[i]]
            into_b[j], b[j] = b[j], self.left[b[j]]
            live = live[(split_a | split_b) & ~bad]
        return good

    def made_of(self, key: np.ndarray) -> np.ndarray:
        """The token that each pair (left * tokens + right) merges into, or NEVER."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NEVER)

    def merged_together(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many short words at once: every pass does each word's lowest merge wherever it occurs.

        New pairs never rank below the merge that made them, so the order within a word is that of `merged`. Where
        occurrences overlap, every second one of the run is taken, from the left.
        """
        out: list[list[int]] = [[]] * len(words)
        parts = [[self.ids[c] for c in w[:-2]] + [self.ids[w[-2:]]] for w in words]
        ids = np.fromiter(chain.from_iterable(parts), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        while len(ids):
            made = np.full(len(ids), NEVER)
            same = owner[1:] == owner[:-1]
            made[:-1][same] = self.made_of(ids[:-1][same] * len(self.text) + ids[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(made, starts)
            lengths = np.diff(np.r_[starts, len(ids)])
            for k in np.flatnonzero(lowest == NEVER):
                out[owner[starts[k]]] = ids[starts[k] : starts[k] + lengths[k]].tolist()
            live = np.repeat(lowest < NEVER, lengths)
            hit = (made == np.repeat(lowest, lengths)) & live
            at = np.arange(len(ids))
            run = at - np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, -1))
            hit &= run % 2 == 0
            ids = np.where(hit, made, ids)
            keep = live & ~np.r_[False, hit[:-1]]
            ids, owner = ids[keep], owner[keep]
        return out

    def encoded(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word, in byte characters with the end mark."""
        out = [self.proposed(w) for w in words]
        sizes = np.array([len(t) if t else 0 for t in out], np.int64)
        flat = np.fromiter(chain.from_iterable([t for t in out if t]), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        inner = owner[1:] == owner[:-1]
        pairs, where = np.unique(flat[:-1][inner] * len(self.text) + flat[1:][inner], return_inverse=True)
        good = self.compatible(pairs // len(self.text), pairs % len(self.text))
        failed = sorted(set(owner[1:][inner][~good[where]].tolist()) | {k for k, t in enumerate(out) if t is None})
        short = [k for k in failed if len(words[k]) <= CACHE_LENGTH]
        for k, t in zip(short, self.merged_together([words[k] for k in short]), strict=True):
            out[k] = t
        for k in failed:
            if len(words[k]) > CACHE_LENGTH:
                out[k] = self.merged(words[k])
        return out


def default_vocabulary(path: str | None = None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path("word_bpe_49k.json"))


def lowered(text: str) -> str:
    """Lower case character by character, without the rule for a sigma at a word's end."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Coder:
    """Encodes texts, and decodes them if asked to, with a cache of words that keeps those met lately."""

    def __init__(self, vocabulary: Vocabulary, decodes: bool = True):
        self.v, self.decodes = vocabulary, decodes
        self.ids: dict[str, tuple[bytes, str | None]] = {}
        self.before: dict[str, tuple[bytes, str | None]] = {}
        self.bytes = str.maketrans({b: c for b, c in enumerate(byte_chars())})

    def pieces(self, text: str | None) -> list[str]:
        """What stands between white space in a text; a special token stands as its name after a blank."""
        out: list[str] = []
        parts = self.v.special_pattern.split(text or "") if self.v.special_pattern else [text or ""]
        for part in parts:
            if part in self.v.special:
                out.append(" " + part)
            elif part:
                # white space parts words whichever it is, so the normalizer's replacing it by blanks changes nothing
                plain = lowered(unicodedata.normalize("NFC", part))
                out += self.v.split_pattern.findall(plain) if any(c in plain for c in SPLIT_TOO) else plain.split()
        return out

    def learn(self, pieces: Iterable[str]) -> dict[str, tuple[bytes, str | None]]:
        """Each piece's ids as little-endian 32-bit integers, and its tokens joined by spaces. A word is a piece, too."""
        find, special, text = self.v.split_pattern.findall, self.v.special, self.v.text
        names = [p for p in pieces if p[0] == " "]
        parted = {p: find(p) for p in pieces if p[0] != " " and not (p.isascii() and p.isalpha())}
        words = {p for p in pieces if p[0] != " " and p not in parted}.union(*parted.values())
        ids, before = self.ids, self.before
        new = []
        for w in words:
            if w not in ids:
                if w in before:
                    ids[w] = before[w]
                else:
                    new.append(w)
        made = self.v.encoded([w.encode().decode("latin-1").translate(self.bytes) + END_MARK for w in new])
        for w, t in zip(new, made, strict=True):
            ids[w] = PACKED[len(t)](*t) if len(t) < len(PACKED) else np.array(t, "<u4").tobytes(), " ".join([text[i] for i in t]) if self.decodes else None
        found = {w: ids[w] for w in words}
        found |= {p: (PACKED[1](special[p[1:]]), p[1:]) for p in names}
        for p, within in parted.items():
            if len(within) != 1:
                some = [ids[w] for w in within]
                found[p] = b"".join([i for i, _ in some]), " ".join([d for _, d in some]) if self.decodes else None
        for w in new:
            if len(w) > CACHE_LENGTH:
                del ids[w]
        if len(ids) > CACHE_WORDS:
            self.ids, self.before = {}, ids
        return found

    def coded(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, str | None]]:
        """(ids, decoded text) of each text; the words of about TOGETHER characters are learnt at once."""
        group, size = [], 0
        for text in texts:
            group.append(self.pieces(text))
            size += len(text or "")
            if size > TOGETHER:
                yield from self._put_together(group)
                group, size = [], 0
        yield from self._put_together(group)

    def _put_together(self, group: list[list[str]]) -> Iterator[tuple[bytes, str | None]]:
        known = self.learn(set().union(*group)).__getitem__
        for pieces in group:
            found = list(map(known, pieces))
            yield b"".join([i for i, _ in found]), " ".join([d for _, d in found]) if self.decodes else None


def _over(df: DataFrame, vocabulary: Vocabulary, schema: str, row, decodes: bool = True) -> DataFrame:
    ready_for_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(shared.value, decodes)
        for frame in frames:
            out = [row(ids, decoded) for ids, decoded in coder.coded(frame["text"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64")} | {k: [x[k] for x in out] for k in (out[0] if out else ())}, columns=[x.split()[0] for x in schema.split(", ")])

    return df.select("doc_id", "text").mapInPandas(batches, schema)


def encode(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) to (doc_id, ids array<int>, decoded string), a row for each row.

    A null or empty text has no ids and decodes to the empty text; doc_id may be null or repeat. Further columns don't
    take part. Texts are read whole. Decoding joins the tokens by spaces, as the file names no decoder.
    """
    return _over(df, vocabulary, "doc_id long, ids array<int>, decoded string", lambda ids, decoded: {"ids": np.frombuffer(ids, "<u4").astype(np.int32), "decoded": decoded})


def token_ids(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) to (doc_id, ids array<int>) as `encode` gives them, without the decoded text."""
    return _over(df, vocabulary, "doc_id long, ids array<int>", lambda ids, decoded: {"ids": np.frombuffer(ids, "<u4").astype(np.int32)}, decodes=False)


def digests(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256); cases as in `encode`."""
    return _over(
        df,
        vocabulary,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, decoded: {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()},
    )
