"""Language identification by cross-parsing with suffix automata."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spreadlens.llm.common import counted_join, documents, held_out
from spreadlens.session import cut_lineage

FOLD, REST = 4, 2
SEGMENT = 256
PHRASE, PAD = 1 << 30, 0
#: Ids of a language (letters, space, two more) and cells of all languages together up to which transitions are tables.
DENSE, DENSE_CELLS = 64, 16 << 20


def _suffix_automaton(ids: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: every path from state 0 spells a part of it."""
    step, link, longest, last = [{}], [-1], [0], 0
    for c in ids:
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        new, p = len(step) - 1, last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                copy = len(step) - 1
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class CrossParser:
    """One automaton for each language; texts are cut greedily into longest parts of the language's sample.

    Characters are lower-cased; runs of anything but letters are one space; 0 pads,
    1 is the space, the last id a letter that no sample holds.  Each language
    numbers its own letters: up to DENSE of them make a table of all states and
    letters, more a sorted array of the transitions that there are.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        seen = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
        self.unknown = len(seen) + 2
        self.kind = np.uint16 if self.unknown < 1 << 16 else np.int32
        self.letters = {ord(c): i + 2 for i, c in enumerate(seen)}
        self.lut = None
        self.tables, self.cost = [], []
        room = DENSE_CELLS
        for lang in self.languages:
            ids = self.ids(samples[lang])
            own = np.unique(np.append(ids, 1).astype(self.kind))
            absent = len(own) + 1
            local = np.full(self.unknown + 1, absent, self.kind)
            local[PAD], local[own] = PAD, np.arange(1, absent)
            step = _suffix_automaton(local[ids].tolist())
            width = absent + 1
            if width <= DENSE and len(step) * width <= room:
                room -= len(step) * width
                table = np.zeros((len(step), width), np.int32)
                for c, to in step[0].items():
                    table[:, c] = to * width  # a phrase that can't go on starts anew with this character
                table |= PHRASE
                for s in range(1, len(step)):
                    for c, to in step[s].items():
                        table[s, c] = to * width
                table[:, PAD] = 0
                self.tables.append((local, width, table.ravel(), None, None))
            else:
                start = np.zeros(width, np.int32)
                for c, to in step[0].items():
                    start[c] = to
                keys, to = np.array(sorted((s * width + c, t) for s in range(1, len(step)) for c, t in step[s].items()) + [(1 << 62, 0)], np.int64).T
                self.tables.append((local, width, start, keys.copy(), to.astype(np.int32)))
            self.cost.append(np.log2(max(4, len(ids))))
        self.cost = np.array(self.cost)
        self.lut = None  # made anew in each task

    def ids(self, text: str) -> np.ndarray:
        if self.lut is None:
            self.lut = np.ones(0x110000, self.kind)
            for c in range(0x34000):
                if chr(c).isalpha():
                    self.lut[c] = self.letters.get(c, self.unknown)
        out = self.lut[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        return out[(out != 1) | np.append(True, out[:-1] != 1)] if len(out) else out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text for each language, parsed in segments of SEGMENT characters that go in step."""
        sizes = [-(-len(t) // SEGMENT) for t in texts]
        out = np.zeros((len(texts), len(self.languages)))
        if not sum(sizes):
            return out
        flat = np.zeros(sum(sizes) * SEGMENT, self.kind)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i, t in enumerate(texts):
            flat[at[i] * SEGMENT:at[i] * SEGMENT + len(t)] = t
        steps = np.ascontiguousarray(flat.reshape(-1, SEGMENT).T)
        live = [int(n) for n in (steps != PAD).any(1)]
        for k, (local, width, table, keys, to) in enumerate(self.tables):
            state, count = np.zeros(steps.shape[1], np.int64 if keys is not None else np.int32), np.zeros(steps.shape[1], np.int32)
            for c, any_left in zip(steps, live):
                if not any_left:
                    break
                c = local[c]
                if keys is None:
                    got = table[state + c]
                    count += got >> 30
                    state = got & (PHRASE - 1)
                else:
                    want = state * width + c
                    found = np.searchsorted(keys, want)
                    goes_on = keys[found] == want
                    count += ~goes_on & (c != PAD)
                    state = np.where(goes_on, to[found], table[c]).astype(np.int64)
            out[:, k] = np.bincount(np.repeat(np.arange(len(texts)), sizes), count, len(texts))
        return out


def fit(docs: DataFrame, max_chars: int = 40_000, max_docs: int = 200, max_total: int = 200_000, least: int = 500) -> CrossParser:
    """Automata of bounded samples of the training fold, one for every language with a letter in its texts.

    A language's distinct texts are ranked by hash, however often each occurs, and
    fill ``max_chars`` characters (``max_total`` over all languages, dealt evenly,
    which bounds the tables that the tasks get, but no fewer than ``least``) in this
    order, at most ``max_docs`` of them.  A text gives a quarter of the characters at
    most, or an even share if there are fewer than four; of a longer one a part is cut out.
    """
    rank = F.pmod(F.xxhash64("text"), F.lit(1 << 62)).alias("rank")
    rows = (docs.filter(~held_out(FOLD, REST)).select("doc_id", "lang", "text")
            .filter("lang is not null and lang <> ''").filter(F.col("text").rlike(r"\p{L}")))
    thin = cut_lineage(rows.select("doc_id", "lang", rank))
    # texts under a share of the ranks that holds about four times max_docs of a language's, and its first in any case
    seen = cut_lineage(thin.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n"), F.min("rank").alias("first")))
    languages = seen.count()
    if not languages:
        return CrossParser({})
    max_chars = max(least, min(max_chars, max_total // languages))
    under = F.least(F.lit(1.0), F.lit(4.0 * max_docs) / F.col("n")) * float(1 << 62)
    # one row for each text, the one with the least doc_id
    some = (counted_join(thin, seen, ["lang"]).filter((F.col("rank") <= under) | (F.col("rank") == F.col("first")))
            .groupBy("lang", "rank").agg(F.min("doc_id").alias("id")))
    by_lang = Window.partitionBy("lang")
    picked = cut_lineage(some.withColumn("nth", F.row_number().over(by_lang.orderBy("rank"))).withColumn("texts", F.count("*").over(by_lang))
                         .filter(F.col("nth") <= max_docs).select(F.col("lang").alias("of"), F.col("rank").alias("at"), "id", "texts"))
    found = counted_join(rows.withColumn("rank", rank), picked,
                         (F.col("lang") == F.col("of")) & (F.col("rank") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id")))
    plain = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    part = F.floor(F.lit(max_chars) / F.least(F.lit(4), F.col("texts"))).cast("int")
    start = F.pmod(F.col("rank"), F.greatest(F.length("plain") - F.col("part") + 1, F.lit(1))).cast("int") + 1
    cut = (found.select("lang", "rank", plain.alias("plain"), part.alias("part"))
           .select("lang", "rank", F.substring("plain", start, F.col("part")).alias("piece")).dropDuplicates(["lang", "rank"]))
    before = F.coalesce(F.sum(F.length("piece")).over(by_lang.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = (cut.withColumn("before", before).filter(F.col("before") < max_chars)
            .select("lang", "rank", F.substring("piece", F.lit(1), (F.lit(max_chars) - F.col("before")).cast("int")).alias("piece")))
    samples: dict[str, list[str]] = {}
    for lang, _, piece in sorted(held.collect()):
        samples.setdefault(lang, []).append(piece)
    return CrossParser({lang: " ".join(pieces) for lang, pieces in samples.items()})


def identify(docs: DataFrame, model: CrossParser, *keep: str) -> DataFrame:
    """``keep`` columns, lang_pred and score of each row's whole text.

    The language whose phrases take the fewest bits a character wins (a phrase of
    a sample with n characters takes log2 n); ties go to the first name.  score is
    the winner's share when languages weigh 2^-bits.  Null texts and texts without
    a letter are ``und`` with score 0, as is everything when nothing was learned.
    """
    schema = docs.select(*keep).schema

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            pred, score = [], []
            i = 0
            while i < len(texts):
                some, total = [], 0
                while i < len(texts) and total < 3_000_000:
                    ids = model.ids(texts[i] or "") if model.languages else np.zeros(0, np.uint16)
                    some.append(ids)
                    total += len(ids)
                    i += 1
                bits = model.phrases(some) * model.cost if model.languages else None
                for k, ids in enumerate(some):
                    if not len(ids) or ids.max() < 2:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    b = bits[k] - bits[k].min()
                    pred.append(model.languages[int(b.argmin())])
                    score.append(float(1.0 / np.exp2(-np.minimum(b, 1000)).sum()))
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])
    return docs.select(*{*keep, "text"}).mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``; repeated rows get equal answers, an empty table gives no rows."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return (identify(docs, fit(docs), "doc_id")
            .select("doc_id", held_out(FOLD, REST).alias("held_out"), "lang_pred", "score"))
