"""Secret scan with corpus-wide ownership frequency."""
from __future__ import annotations

import bisect
import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm.common import documents
from spreadlens.session import cut_lineage

#: Kinds in the order in which spans with one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem", "jwt", "prefixed", "entropy")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
#: A jwt is three runs of these, of 8 at least after its eyJ, with points between.
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
PREFIXED = re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}")
LONG_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def _jwts(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping jwts.

    Where the runs after one eyJ fail, they fail after every later eyJ of its first run
    too, so the search goes on behind that run and reads each run three times at most.
    """
    out, at = [], text.find("eyJ")
    while at >= 0:
        first = JWT_RUN.match(text, at + 3).end()
        after = first
        if first - at >= 11 and text[first:first + 1] == ".":
            second = JWT_RUN.match(text, first + 1).end()
            if second - first >= 9 and text[second:second + 1] == ".":
                third = JWT_RUN.match(text, second + 1).end()
                if third - second >= 9:
                    out.append((at, third))
                    after = third
        at = text.find("eyJ", after)
    return out


def _free_of(spans: list[tuple[int, int]]):
    """Whether (start, end) meets none of ``spans``, by bisection among them, merged."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(s: int, e: int) -> bool:
        i = bisect.bisect_right(ends, s)
        return i == len(starts) or e <= starts[i]
    return free


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of a whole text: base matches, then further ones that meet no base match."""
    text = text or ""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    runs = list(LONG_RUN.finditer(text))
    # 24 of 0-9a-f in a row lie in a run of 20 of the wider class
    out += [(2, m.start(), m.end(), m[0]) for r in runs if r.end() - r.start() >= 24 for m in HEX.finditer(text, r.start(), r.end())]
    free = _free_of([(s, e) for _, s, e, _ in out])
    more = []
    if "PRIVATE KEY-----" in text:
        more += [(3, m.start(), m.end(), m[0]) for m in PEM.finditer(text)]
    if "eyJ" in text:
        more += [(4, s, e, text[s:e]) for s, e in _jwts(text)]
    if runs:
        more += [(5, m.start(), m.end(), m[0]) for m in PREFIXED.finditer(text)]
    for kind, s, e, secret in more:
        if free(s, e):
            out.append((kind, s, e, secret))
    free = _free_of([(s, e) for _, s, e, _ in out])
    for m in runs:
        run = m[0]
        if (any(c.isdigit() for c in run) and any(c.islower() for c in run) and any(c.isupper() for c in run)
                and _entropy(run) >= 3.5 and free(m.start(), m.end())):
            out.append((6, m.start(), m.end(), run))
    return sorted(out, key=lambda c: (c[1], c[0], c[2]))


SPANS = "array<struct<kind:int,start:int,end:int,hash:string>>"


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 2, per_owner: int = 10) -> DataFrame:
    """doc_id and spans (kind, start, end, hash, owners, repositories, live) of every row of ``docs``.

    The hashes of all candidates are counted over the corpus: in how many distinct
    repositories they occur and of how many distinct owners.  A candidate with more
    than ``max_owners`` owners, or in more than ``per_owner`` repositories for each
    owner, of which those with equal texts count as one here, is a widely copied
    example; others are live.  Only hashes are shuffled, combined on the map side by
    (hash, owner, repository) and (hash, text).
    Null texts are empty; a null owner is an owner; repeated rows get equal spans
    and count once; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.col(owner).cast("string").alias("own"), F.col(repository).cast("string").alias("repo"), F.xxhash64("text").alias("doc"))

    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = [[{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()[:32]}
                      for k, s, e, v in candidates(t)] for t in texts]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "own", "repo", "doc")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(found, kind)], ["doc_id", "own", "repo", "doc", "spans"])

    schema = docs.select("doc_id", "own", "repo").schema
    each = cut_lineage(docs.mapInArrow(run, f"doc_id {schema['doc_id'].dataType.simpleString()}, own string, repo string, doc long, spans {SPANS}")
                       .withColumn("row", F.monotonically_increasing_id()))
    flat = each.filter(F.size("spans") > 0).select("row", "own", "repo", "doc", F.explode("spans").alias("s")).select("row", "own", "repo", "doc", "s.*")
    owned = flat.groupBy("hash", F.coalesce("own", F.lit("\0")).alias("own"), F.coalesce("repo", F.lit("\0")).alias("repo")).agg(F.lit(1).alias("one"))
    texts = flat.groupBy("hash", "doc").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("texts"))
    freq = (owned.groupBy("hash", "own").agg(F.count("*").alias("n"))
            .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")).join(texts, "hash"))
    live = (F.col("owners") <= max_owners) & (F.col("texts") <= per_owner * F.col("owners"))
    told = (flat.join(freq, "hash").select("row", F.struct("start", "kind", "end", "hash", "owners", "repositories", live.alias("live")).alias("s"))
            .groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans")))
    empty = each.filter(F.size("spans") == 0).select("doc_id", F.lit(None).cast(told.schema["spans"].dataType).alias("spans"))
    return (each.filter(F.size("spans") > 0).select("row", "doc_id").join(told, "row").select("doc_id", "spans").union(empty)
            .withColumn("spans", F.coalesce("spans", F.array().cast(told.schema["spans"].dataType))))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``; a document is a repository, its source the owner.

    Base spans always stay; of the further kinds the live ones are added, since widely
    copied ones are examples.  owners and repositories are the counts of ``spans``, in order.
    """
    found = scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    shown = F.filter("spans", lambda s: (s["kind"] < 3) | s["live"])
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = lambda c, name: F.array_join(F.transform(c, lambda s: s[name].cast("string")), ",").alias(name)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(shown).alias("spans"), counts(shown, "owners"), counts(shown, "repositories"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"))
