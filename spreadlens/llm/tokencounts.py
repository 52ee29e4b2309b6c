"""Edit-aware token counting with a segment tree of pre-token runs for each document."""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm.common import documents

#: A pre-token never holds a non-blank followed by a blank, nor looks back over it: text cut there
#: encodes to the same ids as the whole.  Leaves end at the first such place after LEAF characters.
LEAF = 256
#: Blanks of the pre-tokenizer's pattern and of Python's agree on these; others are no cutting places.
BLANK = frozenset(" \t\n\r")

#: Digits in runs of 7 or more, and runs of three equal marks.
LONG_NUMBER = re.compile(r"[0-9]{7,}")
MARKS = re.compile(r"%%%|&&&|\$\$\$|###|\*\*\*")


def ranks_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Tokens of a text in a vocabulary given as ranks; special tokens' strings are ordinary text.

    Texts that the pattern engine gives up on, such as a million blanks, are encoded
    with the tokenizers file of the same vocabulary.
    """

    def __init__(self, file: str, tokenizer: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        self.file, self.whole = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), None

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        try:
            return len(self.encode(text))
        except BaseException as e:  # the engine's own panic is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if self.whole is None:
            from tokenizers import Tokenizer
            self.whole = Tokenizer.from_file(self.file)
            self.whole.encode_special_tokens = True
        return len(self.whole.encode(text, add_special_tokens=False).ids)


def _cuts(text: str, leaf: int) -> list[int]:
    """Ends of the leaves of a text."""
    ends, at = [], 0
    while len(text) - at > leaf:
        e = at + leaf
        while e < len(text) and not (text[e] in BLANK and not text[e - 1].isspace()):
            e += 1
        if e >= len(text):
            break
        ends.append(e)
        at = e
    return [*ends, len(text)] if text else []


class Tree:
    """Lengths and token counts of the leaves, and the counts' sums in a binary tree laid out in an array.

    Node i has children 2i and 2i + 1, leaf k is node width + k, the root 1 has the
    count of the document.
    """

    def __init__(self, lengths, counts):
        self.lengths = np.array(lengths, np.int64)
        self.width = 1 << max(0, int(len(self.lengths) - 1).bit_length()) if len(self.lengths) else 1
        self.sums = np.zeros(2 * self.width, np.int64)
        self.sums[self.width:self.width + len(self.lengths)] = counts
        level = self.width
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level].reshape(-1, 2).sum(1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def set(self, leaf: int, count: int) -> int:
        """New count of a leaf; adds the difference to the sums above it and returns the number of nodes touched."""
        at, more, touched = self.width + leaf, count - int(self.sums[self.width + leaf]), 0
        while at and more:
            self.sums[at] += more
            at //= 2
            touched += 1
        return touched


def _safe(left: str, right: str) -> bool:
    """Whether a text may be cut between ``left`` and ``right``."""
    return not left or not right or (right[0] in BLANK and not left[-1].isspace())


def apply(tree: Tree, text: str, edits: list[tuple[int, int, str]], count) -> dict:
    """Apply (start, end, replacement) edits, which are in order and don't overlap, to a text and its tree.

    Leaves that an edit touches are joined with the leaves before and after, as far
    as needed to be cut off safely in the new text, and only these are encoded
    again; a joined region's count goes to its first leaf, the others hold nothing.
    """
    ends = np.cumsum(tree.lengths)
    starts = ends - tree.lengths
    n, new_text, k, at = len(ends), [], 0, 0
    leaves = chars = nodes = 0
    lengths = tree.lengths.copy()
    if n == 0:
        region = "".join(e[2] for e in edits)
        tokens = count(region)
        return {"text": region, "tokens": tokens, "leaves": int(bool(region)), "chars": len(region), "nodes": 0,
                "lengths": [len(region)] if region else [], "counts": [tokens] if region else []}
    # parts: (first leaf, last leaf + 1, text) of regions to encode, found from left to right
    regions: list[list] = []
    for s, e, rep in edits:
        a = min(int(np.searchsorted(ends, s, "right")), n - 1)
        b = min(int(np.searchsorted(starts, e, "left")), n)
        b = max(b, a + 1)
        if regions and a < regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], b)
            regions[-1][2].append((s, e, rep))
        else:
            regions.append([a, b, [(s, e, rep)]])
    i = 0
    while i < len(regions):
        a, b, own = regions[i]
        parts, p = [], int(starts[a])
        for s, e, rep in own:
            parts += [text[p:s], rep]
            p = e
        parts.append(text[p:int(ends[b - 1])])
        region = "".join(parts)
        before = text[max(0, int(starts[a]) - 1):int(starts[a])]
        after = text[int(ends[b - 1]):int(ends[b - 1]) + 1]
        grow_left = a > 0 and (not region or not _safe(before, region))
        grow_right = b < n and (not region or not _safe(region, after))
        if grow_left and i and regions[i - 1][1] == a:  # meets the region before
            i -= 1
            regions[i:i + 2] = [[regions[i][0], b, regions[i][2] + own]]
            continue
        if grow_right and i + 1 < len(regions) and regions[i + 1][0] == b:
            regions[i:i + 2] = [[a, regions[i + 1][1], own + regions[i + 1][2]]]
            continue
        if grow_left or grow_right:
            regions[i][0] -= grow_left
            regions[i][1] += grow_right
            continue
        regions[i].append(region)
        i += 1
    for a, b, _, region in regions:
        new_text += [text[at:int(starts[a])], region]
        at = int(ends[b - 1])
        lengths[a:b] = 0
        lengths[a] = len(region)
        nodes += tree.set(a, count(region))
        for k in range(a + 1, b):
            nodes += tree.set(k, 0)
        leaves += b - a
        chars += len(region)
    new_text.append(text[at:])
    return {"text": "".join(new_text), "tokens": tree.total, "leaves": leaves, "chars": chars, "nodes": nodes, "lengths": lengths.tolist(),
            "counts": tree.sums[tree.width:tree.width + n].tolist()}


def build(docs: DataFrame, leaf: int = LEAF, file: str | None = None) -> DataFrame:
    """doc_id, text, lengths and counts of the leaves of every document's tree, in one pass over whole texts.

    The sums above the leaves follow from them, so they are not stored.  A null
    text has no leaf, like an empty one, and stays null.
    """
    file = file or ranks_file()
    docs = docs.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        count = Counter(file)
        for batch in batches:
            texts = batch.column(1)
            lengths, counts = [], []
            for t in texts.to_pylist():
                ends = _cuts(t or "", leaf)
                at = [0, *ends[:-1]]
                lengths.append([e - s for s, e in zip(at, ends)])
                counts.append([count(t[s:e]) for s, e in zip(at, ends)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(lengths, kind), pa.array(counts, kind)], ["doc_id", "text", "lengths", "counts"])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, lengths array<int>, counts array<int>")


EDITS = "array<struct<start:int,end:int,replacement:string>>"


def apply_edits(trees: DataFrame, file: str | None = None) -> DataFrame:
    """Counts of ``trees`` (doc_id, text, lengths, counts, edits) before and after each row's edits.

    edits is an array of (start, end, replacement) in code points of the text; they
    are put in order by start, then end, equal ones as given, and one that overlaps an earlier one, or is
    null or lies outside the text, is left out.  Returns doc_id, n_tokens,
    n_tokens_edited, n_edits, n_leaves, leaves_encoded, chars_encoded,
    nodes_updated, the edited text and the lengths and counts of its tree, to which
    a next batch of edits can be applied.
    """
    file = file or ranks_file()
    trees = trees.select("doc_id", "text", "lengths", "counts", F.col("edits").cast(EDITS).alias("edits"))

    def run(batches):
        import pyarrow as pa
        count = Counter(file)
        for batch in batches:
            rows = []
            for _, text, lengths, counts, edits in zip(*(batch.column(i).to_pylist() if i else range(batch.num_rows) for i in range(5))):
                text, tree, last, some = text or "", Tree(lengths, counts), 0, []
                valid = [(e["start"], e["end"], e["replacement"] or "") for e in edits or [] if e and None not in (e["start"], e["end"])]
                for s, e, rep in sorted(valid, key=lambda v: v[:2]):
                    if last <= s <= e <= len(text):
                        some.append((s, e, rep))
                        last = e
                was = tree.total
                got = apply(tree, text, some, count) if some else {
                    "text": text, "tokens": was, "leaves": 0, "chars": 0, "nodes": 0, "lengths": lengths, "counts": counts}
                rows.append((was, got["tokens"], len(some), len(lengths), got["leaves"], got["chars"], got["nodes"], got["text"],
                             got["lengths"], got["counts"]))
            cols = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.string()] + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], OUT)
    OUT = ["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_leaves", "leaves_encoded", "chars_encoded", "nodes_updated", "text",
           "lengths", "counts"]
    return trees.mapInArrow(run, f"doc_id {trees.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_tokens_edited long, n_edits int, "
                                 "n_leaves int, leaves_encoded int, chars_encoded long, nodes_updated long, text string, "
                                 "lengths array<int>, counts array<int>")


def cleaning_edits(docs: DataFrame) -> DataFrame:
    """Adds the edits that put 0 for long numbers and nothing for triple marks in each whole text."""
    kinds = docs.columns
    body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))
        for batch in batches:
            edits = []
            for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
                t = t or ""
                some = [{"start": m.start(), "end": m.end(), "replacement": r} for p, r in ((LONG_NUMBER, "0"), (MARKS, "")) for m in p.finditer(t)]
                edits.append(some)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)], [*kinds, "edits"])
    return docs.mapInArrow(run, f"{body}, edits {EDITS}")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` before and after the cleaning edits, by its tree.

    Null and empty texts have none; repeated rows come out again; an empty table gives no rows.
    A very long text is counted whole, leaf by leaf; one that the pattern engine gives up on
    goes through the tokenizers file.  Further columns of the table are not read.
    """
    trees = build(documents(spark, sf_dir))
    return (apply_edits(cleaning_edits(trees)).withColumn("edited_crc32", F.crc32(F.col("text").cast("binary")))
            .drop("text", "lengths", "counts"))
