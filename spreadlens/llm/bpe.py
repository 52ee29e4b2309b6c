"""Byte-level BPE encoding and decoding, merges found by a segment tree over the ranks of adjacent pairs."""
from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache, partial
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm.common import documents

#: No mergeable pair; other keys are rank << 32 | position, so the least one is the leftmost of the lowest rank.
NONE = (1 << 62) - 1
#: Characters and words of the texts that are encoded together; a longer text is split some words at a time.
TOGETHER, SLICE = 1 << 20, 1 << 17
#: Words of which the ids are remembered; longer words than KEPT_SIZE bytes are not, and go through ``merge`` one by one.
KEPT, KEPT_SIZE = 400_000, 64


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Symbols of a word after all merges: always the leftmost pair of the lowest rank, until no pair has one.

    ``ranks`` gives the rank of the pair ``a << 32 | b``, ``merged`` the symbol of a
    rank.  Leaf i of the tree holds the key of the pair that starts at symbol i and
    every inner node the lesser key of its children, so the root names the next
    merge.  A merge changes three leaves: its own, the one before, and the one of
    the symbol that it takes in.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    # plain lists are quicker, arrays hold a long word in an eighth of the memory
    hold = list if n < 4096 else partial(array, "q")
    size = 1 << (n - 1).bit_length()
    keys = [NONE if (r := ranks.get(a << 32 | b)) is None else r << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
    tree = hold([NONE]) * size + hold(keys) + hold([NONE]) * (size - n + 1)
    for p in range(size - 1, 0, -1):
        left, right = tree[2 * p], tree[2 * p + 1]
        tree[p] = left if left < right else right
    after, before, symbols = hold(range(1, n + 1)), hold(range(-1, n - 1)), hold(symbols)
    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        gone, prev = after[i], before[i]
        after[i] = nxt = after[gone]
        symbols[i], symbols[gone] = now, _ = merged[top >> 32], -1
        tree[size + gone] = tree[size + i] = NONE
        if nxt < n:
            before[nxt] = i
            if (r := ranks.get(now << 32 | symbols[nxt])) is not None:
                tree[size + i] = r << 32 | i
        changed = [gone, i]
        if prev >= 0:
            r = ranks.get(symbols[prev] << 32 | now)
            key = NONE if r is None else r << 32 | prev
            if tree[size + prev] != key:
                tree[size + prev] = key
                changed.append(prev)
        for leaf in changed:
            p = (size + leaf) >> 1
            while p:
                left, right = tree[2 * p], tree[2 * p + 1]
                if right < left:
                    left = right
                if tree[p] == left:
                    break
                tree[p] = left
                p >>= 1
    return [s for s in symbols if s >= 0]


class Pairs:
    """Ranks of pairs as sorted arrays, for words by the thousand."""

    def __init__(self, ranks: dict[int, int], merged: list[int]):
        key = np.fromiter(ranks.keys(), np.int64, len(ranks))
        rank = np.fromiter(ranks.values(), np.int64, len(ranks))
        order = np.argsort(key)
        self.key, self.rank, self.merged = np.append(key[order], -1), np.append(rank[order], 0), np.array([*merged, 0], np.int64)
        self.n = len(ranks)

    def keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Key of the pair at each place: rank << 32 | place, or NONE."""
        pair = left << 32 | right
        found = np.searchsorted(self.key[:self.n], pair)
        return np.where(self.key[found] == pair, self.rank[found] << 32 | at, NONE)


def merge_all(symbols: np.ndarray, sizes: np.ndarray, pairs: Pairs) -> np.ndarray:
    """``merge`` of many words at once: a row holds a word's symbols, then -1, and has a tree of its own.

    Each round takes the merge at the root of every tree that has one and renews the
    three leaves' paths, level by level in all trees together.  Symbols that were
    taken in become -1.
    """
    n, width = symbols.shape
    size = 1 << (width - 1).bit_length()
    symbols = symbols.astype(np.int64)
    tree = np.full((n, 2 * size), NONE, np.int64)
    if width > 1:
        tree[:, size:size + width - 1] = np.where(np.arange(1, width) < sizes[:, None], pairs.keys(symbols[:, :-1], symbols[:, 1:], np.arange(width - 1)), NONE)
    half = size
    while half > 1:
        tree[:, half // 2:half] = tree[:, half:2 * half].reshape(n, -1, 2).min(2)
        half //= 2
    after, before = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        top = tree[rows, 1]
        i = top & 0xFFFFFFFF
        gone, prev = after[rows, i], before[rows, i]
        nxt = after[rows, gone]
        now = pairs.merged[top >> 32]
        symbols[rows, i], symbols[rows, gone] = now, -1
        after[rows, i] = nxt
        tree[rows, size + gone] = tree[rows, size + i] = NONE
        more, back = nxt < sizes[rows], prev >= 0
        r, at, following = rows[more], i[more], nxt[more]
        before[r, following] = at
        tree[r, size + at] = pairs.keys(now[more], symbols[r, following], at)
        b, at = rows[back], prev[back]
        tree[b, size + at] = pairs.keys(symbols[b, at], now[back], at)
        r, node = np.concatenate([rows, rows, b]), np.concatenate([gone, i, at]) + size
        while node[0] > 1:
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        rows = rows[tree[rows, 1] != NONE]
    return symbols


@lru_cache(1)
def _later_letters():
    """Letters and numbers that the pattern library knows and the tokenizer's older Unicode tables don't."""
    import regex
    unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    later = np.array([ord(c) for c in regex.findall(r"[\p{L}\p{N}]", unknown)])
    runs = np.split(later, np.flatnonzero(np.diff(later) > 1) + 1)
    return regex.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) + "]")


@lru_cache(1)
def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary -> the byte: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary in the tokenizers library's file format.

    Gives the ids of that library's encode(text, add_special_tokens=False) and the
    text of its decode(ids, skip_special_tokens=False), without truncation and
    padding.  Strings of added tokens become their ids, as there.
    """

    def __init__(self, file: str):
        import public_tokenizers
        import regex
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"], pre.get("type")) != ("BPE", "ByteLevel") or spec["normalizer"] or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or any(model.get(k) for k in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "dropout")) \
                or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{file} is not a plain byte-level BPE vocabulary")
        letters, vocab = _byte_letters(), model["vocab"]
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        later = _later_letters()
        # the same pattern with the tokenizer's letters: later ones count as other characters
        exact = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{later.pattern}]")
        for kind in (r"\p{L}", r"\p{N}"):
            exact = exact.replace(f" ?{kind}+", f" ?[{kind}--{later.pattern}]+")
        self.exact_words = regex.compile(exact, regex.V1)
        self.later, self.pairs, self.known, self.kept = later, Pairs(self.ranks, self.merged), {}, KEPT
        self.ids_of_bytes = np.array(self.byte_id, np.int64)

    def word_ids(self, word: str) -> bytes:
        """ids of one pre-token."""
        return np.array(merge([self.byte_id[b] for b in word.encode()], self.ranks, self.merged), "<u4").tobytes()

    def _learn(self, words: set[str]) -> tuple[set[str], set[str]]:
        """Puts the ids of all words into ``known``; returns the words that hold later letters, and those not to be remembered:
        these, which the two patterns cut differently, and long ones."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.kept:
            self.known.clear()
            new = list(words)
        raw = [w.encode() for w in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for width in (4, 8, 12, 16, 32, KEPT_SIZE):
            low = {4: 0, 8: 4, 12: 8, 16: 12, 32: 16, KEPT_SIZE: 32}[width]
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            for s in range(0, len(own), 1 << 14):
                some = own[s:s + (1 << 14)]
                filled = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in some.tolist()), np.uint8).reshape(-1, width)
                n = sizes[some]
                ids = merge_all(np.where(np.arange(width) < n[:, None], self.ids_of_bytes[filled], -1), n, self.pairs)
                held = ids >= 0
                flat, ends = ids[held].astype("<u4").tobytes(), (4 * np.cumsum(held.sum(1))).tolist()
                at = 0
                for k, end in zip(some.tolist(), ends):
                    self.known[new[k]] = flat[at:end]
                    at = end
        long = [new[k] for k in np.flatnonzero(sizes > KEPT_SIZE).tolist()]
        for w in long:
            self.known[w] = self.word_ids(w)
        later = {w for w in new if not w.isascii() and self.later.search(w)}
        return later, later.union(long)

    def _forget(self, words: set[str]) -> None:
        for w in words:
            del self.known[w]

    def _split(self, pattern, text: str):
        """The words of a text in lists, all at once unless it is long."""
        if len(text) < TOGETHER:
            yield pattern.findall(text)
            return
        words = (m.group() for m in pattern.finditer(text))
        while some := list(islice(words, SLICE)):
            yield some

    def _alone(self, text: str) -> bytes:
        """A text of any length, split some words at a time; anew by the exact pattern if a later letter turns up."""
        for pattern in (self.words, self.exact_words):
            out = []
            for words in self._split(pattern, text):
                later, passing = self._learn(set(words))
                if not (later and pattern is self.words):
                    out.append(b"".join(map(self.known.__getitem__, words)))
                self._forget(passing)
                if later and pattern is self.words:
                    break
            else:
                return b"".join(out)
        raise AssertionError("unreachable")

    def _together(self, texts: list[str]) -> list[bytes]:
        """Short texts whose new words are learned together."""
        split = [self.words.findall(t) for t in texts]
        later, passing = self._learn(set().union(*split))
        out = [None if later and not later.isdisjoint(words) else b"".join(map(self.known.__getitem__, words)) for words in split]
        self._forget(passing)
        return [self._alone(t) if ids is None else ids for t, ids in zip(texts, out)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """ids of whole texts as little-endian unsigned 32-bit integers; none for null."""
        parts, whose = [], []
        for k, text in enumerate(texts):
            for part in self.split_added.split(text) if text and any(t in text for t in self.added) else [text]:
                if part:
                    parts.append(part)
                    whose.append(k)
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        done: list[bytes] = []
        for part in [*parts, None]:
            if held and (part is None or part in self.added or size + len(part) > TOGETHER):
                done += self._together(held) if size <= TOGETHER else [self._alone(held[0])]
                held, size = [], 0
            if part is None:
                break
            if part in self.added:
                done.append(self.added[part])
            else:
                held.append(part)
                size += len(part)
        for k, ids in zip(whose, done):
            out[k].append(ids)
        return [b"".join(x) for x in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, rows: list[bytes | None]) -> list[str]:
        return list(map(self.decode, rows))

    def decode(self, ids: bytes | None) -> str:
        """Text of ids in that form; ids outside the vocabulary give nothing, bytes that are no UTF-8 the replacement character."""
        tokens = np.frombuffer(ids or b"", "<u4").tolist()
        try:
            found = b"".join(map(self.bytes_of.__getitem__, tokens))
        except KeyError:
            found = b"".join(self.bytes_of.get(t, b"") for t in tokens)
        return found.decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(file: str) -> ByteBPE:
    """One for each Python worker, which keeps the words it has learned from task to task."""
    return ByteBPE(file)


def _map(df: DataFrame, source: str, target: str, kind: str, file: str | None, method: str) -> DataFrame:
    """Adds column ``target``: ``method`` of the vocabulary in ``file`` on column ``source``, in Arrow batches."""
    file = file or tokenizer_file()
    if target in df.columns:
        raise ValueError(f"a column {target} is there already")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at, names = df.columns.index(source), [*df.columns, target]

    def run(batches):
        import pyarrow as pa
        call, arrow = getattr(vocabulary(file), method), pa.string() if kind == "string" else pa.binary()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(call(batch.column(at).to_pylist()), arrow)], names)
    return df.mapInArrow(run, f"{fields}, `{target}` {kind}")


def encode(df: DataFrame, text: str = "text", ids: str = "ids", file: str | None = None) -> DataFrame:
    """``df`` with a column of the ids of each whole text: little-endian unsigned 32-bit integers in a binary.

    Null and empty texts have no ids (an empty binary); a text of any length is
    encoded whole, in memory in proportion to it, a word of n bytes without blanks
    in n log n steps.  Each row is encoded on its own, so null ids, repeated rows
    and further columns pass through; an empty table gives no rows.  A column that
    is named like the new one is an error.
    """
    return _map(df, text, ids, "binary", file, "encode_all")


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", file: str | None = None) -> DataFrame:
    """``df`` with a column of the text of each row's ids, in the form of ``encode``; no text for null or no ids."""
    return _map(df, ids, text, "string", file, "decode_all")


def n_tokens(ids: str = "ids") -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text of ``documents`` (see ``encode``)."""
    both = decode(encode(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "ids"))
    return both.select("doc_id", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
