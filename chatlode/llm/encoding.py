"""Encoding of texts with a public byte-level BPE tokenizer by traversal of a trie of distinct words.

The last token of the encoding of a byte string is the one token at its end that is compatible with the last token of
the string before it: BPE of both together leaves the two as they are. So each prefix of a word has a last-token state
that follows from the states of its shorter prefixes. The distinct words of a run of documents are walked as a trie
(sorted, so that the nodes on the path to a word are those of its common prefix with the word before): a shared prefix
gets its states once. Documents pass through one narrow stage; the vocabulary is read once per Python worker.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chatlode.session import table, tokenizer_file

#: Fixed value: the pattern by which the byte-level vocabularies cut a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encoding is kept between runs, and characters of text that make a run; neither changes any result.
KEPT_WORDS = 200_000
RUN_CHARS = 2_000_000


class TrieEncoder:
    """Encodes byte strings with the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        ends: dict[int, set[int]] = {}
        for t in ranks:
            ends.setdefault(t[-1], set()).add(len(t))
        #: Lengths of the tokens that end with a byte, longest first.
        self.lengths = {b: sorted(ls, reverse=True) for b, ls in ends.items()}
        self.token = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> "TrieEncoder":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition: the adjacent pair of lowest rank is merged until none is left. For short strings."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return got

    def alone(self, a: int) -> bool:
        got = self.whole.get(a)
        if got is None:
            got = self.whole[a] = self.merge(self.token[a]) == [a]
        return got

    def walk(self, words: list[bytes]):
        """Encodings of sorted distinct words; the states of the path to the word before are reused up to the fork."""
        ranks, lengths, compatible, alone = self.ranks, self.lengths, self.compatible, self.alone
        last, size, before = [-1], [0], b""  # state of each depth: last token and its length
        for w in words:
            n, depth = len(w), 0
            if before[:1] == w[:1]:
                low, high = 0, min(len(before), n)
                while low < high:  # length of the common prefix
                    mid = (low + high + 1) // 2
                    if before[:mid] == w[:mid]:
                        low = mid
                    else:
                        high = mid - 1
                depth = low
            del last[depth + 1 :], size[depth + 1 :]
            for i in range(depth + 1, n + 1):
                for k in lengths[w[i - 1]]:
                    if k <= i:
                        t = ranks.get(w[i - k : i])
                        if t is not None and (compatible(last[i - k], t) if k < i else alone(t)):
                            last.append(t)
                            size.append(k)
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, i = [], n
            while i:
                ids.append(last[i])
                i -= size[i]
            before = w
            yield ids[::-1]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for an empty or null text. Unpaired surrogates count as U+FFFD."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
        new = {w for ws in cut for w in ws if w not in known}
        coded = sorted((w.encode("utf-8", "replace") if w.isascii() else w.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode(), w) for w in new)
        distinct = sorted({b for b, _ in coded})
        ids = dict(zip(distinct, self.walk(distinct)))
        for b, w in coded:
            known[w] = ids[b]
        out = []
        for ws in cut:
            one: list[int] = []
            for w in ws:
                one += known[w]
            out.append(one)
        return out


_LOADED: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    if path not in _LOADED:
        _LOADED[path] = TrieEncoder.load(path)
    return _LOADED[path]


def runs(texts: list[str | None]):
    """Slices of `texts` of about RUN_CHARS characters."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= RUN_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.tiktoken", folder: str | None = None, lengths: bool = False) -> DataFrame:
    """key, ids of every document, or key, n_tokens with `lengths`; one row for each row of `documents`.

    Null and empty texts get an empty list (0 tokens); a blank text is encoded like any other. No special tokens: their
    strings are ordinary text. Repeated rows each keep their row; an empty table gives an empty result.
    `folder` names the place of the vocabulary files on every executor.
    """
    path = tokenizer_file(name, folder)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in runs(texts):
                got = enc.encode(texts[s:e])
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                keys = b.column(0).slice(s, e - s)
                if lengths:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(sizes)], names=[key, "n_tokens"])
                else:
                    flat = np.fromiter((i for g in got for i in g), np.int32, int(sizes.sum()))
                    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([keys, ids], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens long" if lengths else "ids array<int>"))


def p7_ids(spark, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"))
