"""Mixing sources to target shares of tokens by Pareto order sampling.

The mix is the largest in which every source can reach its share without
repeating a document more often than allowed. A document's expected number of
copies is its source's, times its weight; the whole part of it is certain, and
the rest is the odds of one more copy. For that one, each document draws a
random number u and is ranked by the odds of u over the odds of its rest
(Pareto order sampling); in a source, the lowest ranks are taken up to the
tokens that are still to be filled, so size is fixed and the odds are unequal.

No source is ever sorted or brought to one task. The rank at which a source is
cut is found by histograms of tokens over ranks, narrowed in a few passes to
single documents; each histogram is of a fixed size, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import VOCABULARY, count_tokens
from tideline.session import fits, materialise

#: Sources with a target: a parameter table. Above this it is refused.
MAX_SOURCES = 10_000
#: Bits of the rank that one pass of narrowing resolves.
PASS_BITS = 10
#: Bits of a rank.
RANK_BITS = 62


def source_key(c: Column) -> Column:
    """Sources agree after trimming and lower-casing."""
    return F.lower(F.trim(c))


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, weight: str | None = None) -> DataFrame:
    """doc_id, source (normalised), tokens, weight of every document, written once to the shared folder."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), w.alias("weight"), "text")
    counted = count_tokens(rows, "text", "tokens", vocabulary).drop("text")
    return materialise(counted, "sizes")


def _rank(copies: Column, seed: int) -> Column:
    """Pareto rank as an integer that grows with it, from 0 on; by doc_id, so any order of rows gives the same."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rest = copies - F.floor(copies)
    odds = u / (1 - u) / (rest / (1 - rest))
    # q / (1 + q) keeps the order and lies between 0 and 1.
    return F.floor(odds / (1 + odds) * float(1 << 53)).cast("long") * F.lit(1 << (RANK_BITS - 53)) + F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << (RANK_BITS - 53)))


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """The target table: null sources, shares of 0 or less or null and repeats below 1 or null have no part; shares of repeated sources add up."""
    rows = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    if not fits(rows, MAX_SOURCES):
        raise ValueError(f"more than {MAX_SOURCES} targets")
    out: dict[str, tuple[float, int]] = {}
    for r in rows.collect():
        if r.source is not None and r.target_share and r.target_share > 0 and r.max_repeats and r.max_repeats > 0:
            share, repeats = out.get(r.source, (0.0, 0))
            out[r.source] = share + r.target_share, max(repeats, r.max_repeats)
    return [(k, *v) for k, v in sorted(out.items())]


class Mix:
    """A mix of documents; see mix."""

    def __init__(self, copies: DataFrame, report: DataFrame):
        #: doc_id, source, tokens, copies (1 and more) of each document in the mix.
        self.copies = copies
        #: source, target_share, actual_share, tokens, documents, available_tokens, max_repeats, repeats_used.
        self.report = report


def _scale(wanted: float, sums: list[tuple[float, float]], cap: int) -> float:
    """Copies per unit of weight so that min(cap, scale * weight) of documents has the wanted tokens; sums: (weight, tokens)."""
    lo, hi = 0.0, cap / min(w for w, _ in sums)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap, mid * w) * t for w, t in sums) < wanted else (lo, mid)
    return hi


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, weight: str | None = None,
    vocabulary: str = VOCABULARY, seed: int = 20240229,
) -> Mix:
    """Draw a mix in which each source has its share of the tokens.

    documents: doc_id (unique, not null), text, source; others are not read.
    targets: source, target_share, max_repeats. Sources agree after trimming
    and lower-casing. Documents without a source or of one without a target are
    not in the mix, nor are those without tokens (null and empty texts). A
    target without tokens gets nothing; the shares of the others then stand to
    each other as their targets do. weight: a numeric column of relative odds;
    null and values of 0 or less leave a document out; without it, all
    documents of a source are alike. total_tokens: size of the mix; by default,
    and at most, the largest at which no source needs more than max_repeats of
    its documents. Each source reaches its share to within one document.
    Empty tables give an empty mix; repeated rows of targets add up.
    """
    spark = documents.sparkSession
    wanted = _targets(targets)
    schema = "source string, target_share double, max_repeats int"
    # Bounded by MAX_SOURCES.
    target_rows = spark.createDataFrame(wanted, schema)
    docs = sized(documents, vocabulary, weight).filter((F.col("tokens") > 0) & (F.col("weight") > 0))
    docs = docs.join(F.broadcast(target_rows.select("source", "max_repeats")), "source")
    # Weights are grouped to 1/16 octaves; without a weight column there is one group.
    if weight:
        docs = docs.withColumn("weight", F.pow(F.lit(2.0), F.round(F.log2("weight") * 16) / 16))
    groups = docs.groupBy("source", "weight").agg(F.sum("tokens").alias("tokens")).collect()
    sums: dict[str, list[tuple[float, float]]] = {}
    for g in groups:
        sums.setdefault(g.source, []).append((g.weight, float(g.tokens)))
    have = [(s, share, cap) for s, share, cap in wanted if s in sums]
    scale: dict[str, float] = {}
    need: dict[str, float] = {}
    if have:
        whole = sum(share for _, share, _ in have)
        largest = min(cap * sum(t for _, t in sums[s]) * whole / share for s, share, cap in have)
        total = min(largest, total_tokens) if total_tokens is not None else largest
        for s, share, cap in have:
            need[s] = total * share / whole
            scale[s] = _scale(need[s], sums[s], cap)
    plan = spark.createDataFrame([(s, scale[s]) for s in scale], "source string, scale double")
    docs = docs.join(F.broadcast(plan), "source")
    expected = F.least(F.col("max_repeats").cast("double"), F.col("scale") * F.col("weight"))
    # A rest of less than a millionth is rounding.
    near = F.round(expected)
    expected = F.when(F.abs(expected - near) < 1e-6, near).otherwise(expected)
    docs = docs.withColumn("expected", expected).withColumn("certain", F.floor("expected").cast("int"))
    docs = docs.withColumn("drawn", F.col("expected") > F.col("certain"))
    docs = docs.withColumn("rank", F.when(F.col("drawn"), _rank(F.col("expected"), seed)))
    certain = {r.source: int(r.n) for r in docs.groupBy("source").agg(F.sum(F.col("certain") * F.col("tokens")).alias("n")).collect()}
    cut = _cuts(docs.filter("drawn"), {s: need[s] - certain.get(s, 0) for s in need})
    cuts = spark.createDataFrame(list(cut.items()), "source string, cut long")
    copies = (
        docs.join(F.broadcast(cuts), "source", "left")
        .withColumn("copies", F.col("certain") + F.coalesce((F.col("rank") < F.col("cut")).cast("int"), F.lit(0)))
        .filter(F.col("copies") > 0)
        .select("doc_id", "source", "tokens", "copies")
    )
    # One row per source with a target in each of these.
    reached = {
        r.source: r
        for r in copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("used")).collect()
    }
    available = {s: int(sum(t for _, t in g)) for s, g in sums.items()}
    everything = sum(r.tokens for r in reached.values())
    rows = []
    for s, share, cap in wanted:
        r = reached.get(s)
        got = (r.tokens / everything, r.tokens, r.documents) if r else (0.0, 0, 0)
        rows.append((s, share, *got, available.get(s, 0), cap, r.used if r else 0))
    report = spark.createDataFrame(
        rows, "source string, target_share double, actual_share double, tokens long, documents long, available_tokens long, max_repeats int, repeats_used int"
    )
    return Mix(copies, report)


def _cuts(docs: DataFrame, fill: dict[str, float]) -> dict[str, int]:
    """Per source the rank below which documents are taken so that their tokens come nearest to fill.

    Each pass takes the tokens of 2**PASS_BITS equal stretches of the stretch
    that the cut was narrowed to, per source: sources x 1024 numbers at most.
    A source is settled when one document is left to decide on.
    """
    spark = docs.sparkSession
    low, taken, cut = {s: 0 for s in fill}, {s: 0.0 for s in fill}, {}
    bits = RANK_BITS
    while low:
        width = max(0, bits - PASS_BITS)
        at = spark.createDataFrame(list(low.items()), "source string, low long")
        rows = docs.join(F.broadcast(at), "source").filter(F.col("rank") >= F.col("low"))
        rows = rows.withColumn("bin", F.shiftright(F.col("rank") - F.col("low"), width)).filter(F.col("bin") < (1 << (bits - width)))
        bins: dict[str, list[tuple[int, int, int]]] = {}
        for r in rows.groupBy("source", "bin").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect():
            bins.setdefault(r.source, []).append((r.bin, r.t, r.n))
        for s in list(low):
            for b, tokens, n in sorted(bins.get(s, [])):
                if taken[s] + tokens <= fill[s]:
                    taken[s] += tokens
                    continue
                start = low[s] + (b << width)
                if n == 1 or not width:
                    nearer = taken[s] + tokens - fill[s] < fill[s] - taken[s]
                    cut[s] = start + (1 << width) if nearer else start
                    del low[s]
                else:
                    low[s] = start
                break
            else:
                cut[s] = low.pop(s) + (1 << bits)
        bits = width
    return cut
