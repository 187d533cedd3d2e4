"""Subject areas of documents: term weights, truncated SVD, refined seed centroids.

Every text becomes a vector of weighted terms; a truncated singular value
decomposition of all vectors (subspace iteration, whose passes are distributed
sums) gives the embedding. Seed centroids come from labelled documents, or from
the description of a subject without any, and are refined over the whole corpus
by the documents that are purely theirs. A document is a candidate for the
subjects to whose centroids, freed of the common background, its cosine is
large enough. Centroids overlap, so a check follows: the cosines, corrected for
the overlap of the centroids with each other and with the background, say how
much of the document each subject makes up.

What the driver and the executors hold has a size fixed by the parameters:
DIMENSIONS numbers of documents per term, DIMENSIONS x RANK for the embedding,
MAX_LABELLED labelled documents, some centroids per subject. All counts, the
decomposition and the refinement cover all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import fits, materialise

#: Terms are hashed to so many dimensions.
DIMENSIONS = 1 << 18
#: Singular vectors kept.
RANK = 96
#: Passes of subspace iteration.
PASSES = 3
#: The terms in most documents are multiplied as dense blocks of so many, over so many rows; the others as sparse ones.
DENSE_TERMS, DENSE_ROWS = 8192, 512
#: Documents that a term must be in; natural log of documents per document with the term, below which a term says nothing.
LEAST_DOCUMENTS, LEAST_WEIGHT = 3, 0.4
#: Rows that the table of subjects may have.
MAX_SUBJECTS = 1000
#: Labelled documents used at most, those with the least hash of doc_id.
MAX_LABELLED = 20_000
#: Cosine to a centroid of a subject from which on a document is a candidate for it.
COSINE = 0.12
#: Part of a document from which on it deals with a subject.
THRESHOLD = 0.22
#: A document is purely of one subject with so much of it and less than that of any other.
PURE, OTHER = 0.6, 0.15
#: Further centroids of a subject: labelled documents explained below this ...
UNEXPLAINED = 0.3
#: ... that have so many labelled documents within this cosine, of which this share has the subject.
COMPANY, COMPANY_COSINE, COMPANY_SHARE = 3, 0.6, 0.8
#: Their cosine with every centroid there is is below this: of another kind, neither mislabelled nor a subject's with more of the common terms.
NEW_COSINE = 0.45
#: Share of the labelled documents nearest to a further centroid that must have its subject, before and after refinement.
BORNE_OUT = 0.7
#: Numbers in a block of a sum; tasks that make a sum, per core.
SUM_BLOCK, TASKS_PER_CORE = 1 << 18, 2
#: Steps of the non-negative decomposition.
STEPS = 40

_UPPER = "A-ZÀ-ÖØ-Þ"
#: Parts of identifiers: runs of capitals, or a letter with the small ones after it.
_TERMS = re.compile(rf"[{_UPPER}]+(?![^\W\d_{_UPPER}])|[{_UPPER}]?[^\W\d_{_UPPER}]+").findall
#: Runs of letters, which the parts of an identifier never cross; the same in ASCII texts, where smaller sets are faster.
_LETTERS, _ASCII_LETTERS = re.compile(r"[^\W\d_]+").findall, re.compile(r"[A-Za-z]+").findall
#: Runs of scripts that put no spaces between words (Thai, Lao, Burmese, Khmer, Japanese, Chinese), and Korean, whose words are mostly of two.
_UNSPACED = re.compile("[\u0e01-\u0e4e\u0e81-\u0ece\u1000-\u103f\u1780-\u17d3\u3005\u3041-\u3096\u30a1-\u30fa\u30fc\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U000323af]+")
_COMMENTS_AT_START = re.compile(r"\A(?:[ \t]*(?://|#|/\*|\*|--|<!--|;|%)[^\n]*\n)+")
_LICENCE = re.compile(r"licen[cs]e|spdx|copyright|terms:", re.IGNORECASE)


def terms(text: str) -> dict[str, int]:
    """Terms of a text with their counts: lower-case words of three letters and more, out of identifiers too.

    Of scripts without spaces, and of Korean, every two characters side by side
    are a term. Comments at the very start that speak of a licence are left out, unless
    they are all there is.
    """
    head = _COMMENTS_AT_START.match(text)
    body = text[head.end() :] if head and _LICENCE.search(head.group()) else text
    find = _ASCII_LETTERS if text.isascii() else _LETTERS
    runs = find(body)
    if not runs:
        body, runs = text, find(text)
    out: dict[str, int] = {}
    if not body.isascii() and _UNSPACED.search(body):
        for run in _UNSPACED.findall(body):
            for pair in map("".join, zip(run, run[1:])):
                out[pair] = out.get(pair, 0) + 1
    for run, n in Counter(runs).items():
        for w in _words(run):
            out[w] = out.get(w, 0) + n
    return out


#: Runs of letters and terms that a worker remembers.
REMEMBERED = 1 << 17


@lru_cache(REMEMBERED)
def _words(run: str) -> tuple[str, ...]:
    """Terms of a run of letters, without those of scripts that are taken by pairs."""
    parts = _TERMS(run)
    if not run.isascii():
        parts = [part for w in parts for part in _UNSPACED.split(w)]
    return tuple(w.lower() for w in parts if len(w) >= 3)


@lru_cache(REMEMBERED)
def _dimension(term: str) -> int:
    return zlib.crc32(term.encode("utf-8")) % DIMENSIONS


def _hashed(text: str | None) -> dict[int, int]:
    out: dict[int, int] = {}
    for w, n in terms(text or "").items():
        d = _dimension(w)
        out[d] = out.get(d, 0) + n
    return out


def term_vectors(documents: DataFrame) -> DataFrame:
    """doc_id, dims, counts: the hashed terms of every document; empty for null, empty and blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [_hashed(x) for x in batch.column("text").to_pylist()]
            offsets = np.zeros(len(vectors) + 1, np.int32)
            np.cumsum([len(v) for v in vectors], out=offsets[1:])
            dims = np.fromiter((d for v in vectors for d in v), np.int32, offsets[-1])
            counts = np.fromiter((n for v in vectors for n in v.values()), np.int32, offsets[-1])
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (dims, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "dims", "counts"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, dims array<int>, counts array<int>")


class Space:
    """Term weights and the basis of the embedding."""

    def __init__(self, weights: np.ndarray):
        #: Position of a dimension among those with a weight, or -1.
        self.position = np.full(DIMENSIONS, -1, np.int32)
        # Rising weights: the terms in most documents first.
        active = np.flatnonzero(weights > 0)
        active = active[np.argsort(weights[active], kind="stable")]
        self.position[active] = np.arange(len(active))
        self.weights = weights[active].astype(np.float32)
        self.basis = np.zeros((len(active), 0), np.float32)

    def sparse(self, dims: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, position and value of the weighted terms; rows have length 1, or are empty."""
        rows = np.repeat(np.arange(len(dims)), np.diff(dims.offsets.to_numpy()))
        at = self.position[dims.flatten().to_numpy()]
        have = at >= 0
        rows, at = rows[have], at[have]
        value = np.log1p(counts.flatten().to_numpy()[have]).astype(np.float32) * self.weights[at]
        length = np.sqrt(np.bincount(rows, value * value, minlength=len(dims)))
        return rows, at, (value / np.maximum(length, 1e-12)[rows]).astype(np.float32)

    def project(self, rows: np.ndarray, at: np.ndarray, value: np.ndarray, n: int, gram: np.ndarray | None = None) -> np.ndarray:
        """The rows in the basis; to gram is added what the rows make of it, the transposed rows times that."""
        rank = self.basis.shape[1]
        out = np.zeros((n, rank), np.float32)
        most = min(DENSE_TERMS, len(self.weights))
        rare = np.flatnonzero(at >= most)
        rare_rows, rare_at, rare_value = rows[rare], at[rare], value[rare]
        if len(rare):
            for j in range(rank):
                out[:, j] = np.bincount(rare_rows, rare_value * self.basis[rare_at, j], minlength=n)
        for low in range(0, n, DENSE_ROWS):
            high = min(n, low + DENSE_ROWS)
            a, b = np.searchsorted(rows, [low, high])
            often = at[a:b] < most
            dense = np.zeros((high - low, most), np.float32)
            dense[rows[a:b][often] - low, at[a:b][often]] = value[a:b][often]
            out[low:high] += dense @ self.basis[:most]
            if gram is not None:
                gram[:most] += dense.T @ out[low:high]
        if gram is not None and len(rare):
            for j in range(rank):
                gram[:, j] += np.bincount(rare_at, rare_value * out[rare_rows, j], minlength=len(gram))
        return out

    def embed(self, dims: pa.ListArray, counts: pa.ListArray) -> np.ndarray:
        """Unit vectors, or zeros for rows without weighted terms."""
        e = self.project(*self.sparse(dims, counts), len(dims))
        return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            # A slice's lists still have the offsets of the whole batch.
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.columns], piece.schema.names)


def _summed(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...], kind: type = np.float32) -> np.ndarray:
    """Sum over tasks of an array of a fixed shape.

    As many tasks as there are cores, some times over, make one array each,
    whatever the size of df; blocks of rows of them are added up in parallel,
    so no task and no message holds more than a block of each.
    """
    spark = df.sparkSession
    if 0 in shape:
        return np.zeros(shape)
    width = int(np.prod(shape[1:]))
    rows = max(1, SUM_BLOCK // width)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = part(batches).reshape(shape[0], width)
        for block in range(-(-shape[0] // rows)):
            piece = own[block * rows : (block + 1) * rows]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([piece.astype(kind).tobytes()], pa.binary())], ["block", "sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = -1, np.zeros(0)
        for batch in batches:
            for block, x in zip(batch.column("block").to_pylist(), batch.column("sum")):
                piece = np.frombuffer(x.as_buffer(), kind)
                if block != at:
                    if at >= 0:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.astype(kind).tobytes()], pa.binary())], ["block", "sum"])
                    at, total = block, np.zeros(len(piece))
                total += piece
        if at >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.astype(kind).tobytes()], pa.binary())], ["block", "sum"])

    cores = spark.sparkContext.defaultParallelism
    sums = df.coalesce(TASKS_PER_CORE * cores).mapInArrow(first, "block long, sum binary")
    added = sums.repartition(min(cores, -(-shape[0] // rows)), "block").sortWithinPartitions("block").mapInArrow(add, "block long, sum binary")
    total = np.zeros((shape[0], width))
    # All of it has the fixed shape.
    for row in added.collect():
        piece = np.frombuffer(row["sum"], kind).reshape(-1, width)
        total[row["block"] * rows : row["block"] * rows + len(piece)] = piece
    return total.reshape(shape)


def fit_space(vectors: DataFrame) -> Space:
    """Term weights and truncated SVD over all vectors."""
    spark = vectors.sparkSession

    def seen(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        found = np.zeros(DIMENSIONS + 1)
        for batch in batches:
            dims = batch.column("dims")
            found[:DIMENSIONS] += np.bincount(dims.flatten().to_numpy(), minlength=DIMENSIONS)
            found[DIMENSIONS] += (np.diff(dims.offsets.to_numpy()) > 0).sum()
        return found

    # Documents with each term; the last number is that of documents with any.
    *found, n = _summed(vectors.select("dims"), seen, (DIMENSIONS + 1,), np.float64)
    found = np.array(found)
    weights = np.zeros(DIMENSIONS)
    some = found >= LEAST_DOCUMENTS
    weights[some] = np.log(n / found[some])
    weights[weights < LEAST_WEIGHT] = 0
    space = Space(weights)
    size = len(space.weights)
    rank = min(RANK, size)
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(size, rank)))[0] if size else np.zeros((0, 0))
    for _ in range(PASSES):
        space.basis = q.astype(np.float32)
        sent = spark.sparkContext.broadcast(space)

        def gram(batches: Iterator[pa.RecordBatch], sent=sent) -> np.ndarray:
            own = sent.value
            total = np.zeros(own.basis.shape, np.float64)
            for piece in _pieces(batches, 16384):
                own.project(*own.sparse(piece.column("dims"), piece.column("counts")), piece.num_rows, total)
            return total

        total = _summed(vectors.select("dims", "counts"), gram, (size, rank))
        q = np.linalg.qr(total)[0] if size else total
        sent.unpersist()
    space.basis = q.astype(np.float32)
    return space


def embeddings(vectors: DataFrame, space: Space) -> DataFrame:
    """doc_id, e: the unit embedding as bytes of 32-bit floats; rows without weighted terms are left out."""
    sent = vectors.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            e = sent.value.embed(piece.column("dims"), piece.column("counts"))
            have = np.flatnonzero((e != 0).any(axis=1))
            ids = piece.column("doc_id").take(pa.array(have))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in e[have]], pa.binary())], ["doc_id", "e"])

    return vectors.mapInArrow(run, "doc_id long, e binary")


def _matrix(e: pa.Array, rank: int) -> np.ndarray:
    return np.frombuffer(b"".join(e.to_pylist()), np.float32).reshape(-1, rank)


class Centroids:
    """Unit vectors with the subject of each, and the background."""

    def __init__(self, vectors: np.ndarray, owner: list[int], background: np.ndarray, subjects: int):
        self.vectors, self.owner, self.background, self.subjects = vectors, np.array(owner, int), background, subjects

    def cosines(self, e: np.ndarray) -> np.ndarray:
        """Cosine of each row to the nearest centroid of each subject, freed of the background."""
        x = e @ _unit(self.vectors - np.outer(self.vectors @ self.background, self.background)).T
        best = np.full((len(e), self.subjects), -1.0)
        for c, s in enumerate(self.owner):
            best[:, s] = np.maximum(best[:, s], x[:, c])
        return best

    def parts(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Non-negative parts of each centroid in each row; the same by subject.

        Least squares on the cosines: with g the cosines of the centroids to
        each other, x such that x g is nearest to the cosines of the row.
        """
        f = np.vstack([self.vectors, self.background])
        g = f @ f.T + 1e-3 * np.eye(len(f))
        h = e @ f.T
        bound = np.linalg.eigvalsh(g)[-1]
        x = np.maximum(h, 0) / 2
        y, t = x, 1.0
        for _ in range(STEPS):
            new = np.maximum(y - (y @ g - h) / bound, 0)
            t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            y, x = new + (last - 1) / t * (new - x), new
        x = x[:, :-1]
        by = np.zeros((len(e), self.subjects))
        for c, s in enumerate(self.owner):
            by[:, s] += x[:, c]
        return x, by


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _refined(found: DataFrame, seeds: Centroids, passes: int, least: float = PURE) -> Centroids:
    """Each centroid becomes the mean of the documents that are purely its own, if there are three; least: so much of it."""
    rank = seeds.vectors.shape[1]
    now = seeds
    for _ in range(passes):

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> np.ndarray:
            total = np.zeros((len(now.owner), rank + 1))
            for batch in batches:
                e = _matrix(batch.column("e"), rank)
                x, by = now.parts(e)
                order = np.sort(by, axis=1)
                second = order[:, -2] if order.shape[1] > 1 else np.zeros(len(e))
                pure = (order[:, -1] > least) & (second < OTHER)
                best = x.argmax(axis=1)
                for c in np.unique(best[pure]):
                    mine = pure & (best == c)
                    total[c, :rank] += e[mine].sum(axis=0)
                    total[c, rank] += mine.sum()
            return total

        total = _summed(found.select("e"), sums, (len(now.owner), rank + 1), np.float64)
        vectors = now.vectors.copy()
        enough = total[:, rank] >= 3
        vectors[enough] = _unit(total[enough, :rank])
        now = Centroids(vectors, list(now.owner), now.background, now.subjects)
    return now


def _further(now: Centroids, e: np.ndarray, has: np.ndarray) -> Centroids:
    """Centroids for kinds of documents that the first ones do not explain: other languages, other forms.

    e: embeddings of labelled documents, has: their subjects. Raters err, so a
    document counts only with like ones around it that mostly share a subject.
    """
    least = now.parts(e)[1].max(axis=1)
    new: list[np.ndarray] = []
    owner: list[int] = []
    for a in np.argsort(least, kind="stable"):
        if least[a] >= UNEXPLAINED:
            break
        if new and (np.array(new) @ e[a]).max() > COMPANY_COSINE:
            continue
        near = e @ e[a] > COMPANY_COSINE
        share = has[near].mean(axis=0)
        s = int(share.argmax())
        if near.sum() >= COMPANY and share[s] >= COMPANY_SHARE:
            v = _unit(e[near & has[:, s]].mean(axis=0))
            if (now.vectors @ v).max() < NEW_COSINE:
                new.append(v)
                owner.append(s)
    if not new:
        return now
    return Centroids(np.vstack([now.vectors, *new]), [*now.owner, *owner], now.background, now.subjects)


def _borne_out(now: Centroids, first: int, e: np.ndarray, has: np.ndarray) -> Centroids:
    """Without those of the further centroids (from `first` on) whose labelled documents are not mostly of their subject."""
    best = now.parts(e)[0].argmax(axis=1)
    keep = [c for c, s in enumerate(now.owner) if c < first or ((best == c).any() and has[best == c, s].mean() >= BORNE_OUT)]
    return Centroids(now.vectors[keep], list(now.owner[keep]), now.background, now.subjects)


def fitted(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> tuple[DataFrame, Centroids, list[str]] | None:
    """Embeddings of the documents, centroids, and the subjects' names; None without subjects or terms."""
    spark = documents.sparkSession
    rows = subjects.select("subject", "description").filter(F.col("subject").isNotNull())
    if not fits(rows, MAX_SUBJECTS):
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    listed = {r.subject: r.description or "" for r in rows.collect()}
    names = sorted(listed)
    vectors = materialise(term_vectors(documents), "terms")
    space = fit_space(vectors)
    rank = space.basis.shape[1]
    if not names or not rank:
        return None
    found = materialise(embeddings(vectors, space), "embeddings")

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(rank)
        for batch in batches:
            out += _matrix(batch.column("e"), rank).sum(axis=0)
        return out

    background = _unit(_summed(found.select("e"), total, (rank,), np.float64))
    votes = labels.filter(F.col("doc_id").isNotNull() & F.col("subject").isin(names)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("has"))
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    known = found.join(F.broadcast(sample), "doc_id").orderBy("doc_id").collect()
    e = np.frombuffer(b"".join(r.e for r in known), np.float32).reshape(-1, rank).astype(np.float64)
    has = np.zeros((len(known), len(names)), bool)
    for i, r in enumerate(known):
        has[i, [names.index(s) for s in r.has]] = True
    first = []
    for s, name in enumerate(names):
        own = e[has[:, s] & (has.sum(axis=1) == 1)]
        if len(own):
            first.append(_unit(own.mean(axis=0)))
        else:
            v = _hashed(listed[name])
            lists = [pa.array([list(x)], pa.list_(pa.int32())) for x in (v, v.values())]
            first.append(space.embed(*lists)[0].astype(np.float64))
    centroids = Centroids(np.array(first), list(range(len(names))), background, len(names))
    if not all((has[:, s] & (has.sum(axis=1) == 1)).any() for s in range(len(names))):
        # A description has few of a subject's terms: its documents are less like it than like each other.
        centroids = _refined(found, centroids, 2, PURE / 2)
    centroids = _refined(found, centroids, 2)
    if len(known):
        for _ in range(2):
            centroids = _borne_out(_further(centroids, e, has), len(names), e, has)
            centroids = _borne_out(_refined(found, centroids, 1), len(names), e, has)
    return found, centroids, names


def subject_areas(documents: DataFrame, subjects: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, subject: a row for each subject that a document is near to and that makes up at least the threshold of it.

    documents: doc_id, text; subjects: subject, description (a small table of
    parameters, refused beyond MAX_SUBJECTS rows); labels: doc_id, subject, of
    any raters. Null, empty and blank texts, and texts whose words are all too common or too rare to weigh, have
    no subject. Labels of other subjects or documents, or with nulls, are not
    used. Empty subjects or documents give no rows. Other columns are not read.
    """
    result, fit = "doc_id long, subject string", fitted(documents, subjects, labels)
    if fit is None:
        return documents.sparkSession.createDataFrame([], result)
    found, centroids, names = fit
    rank = centroids.vectors.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _matrix(batch.column("e"), rank)
            near = centroids.cosines(e) >= COSINE
            some = np.flatnonzero(near.any(axis=1))
            at, s = np.nonzero(near[some] & (centroids.parts(e[some])[1] >= threshold))
            row = some[at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array([names[i] for i in s], pa.string())], ["doc_id", "subject"])

    return found.mapInArrow(assign, result)
