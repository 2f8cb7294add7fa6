"""Toxic spans by a linear-chain conditional random field over words, summed up to document scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import crc_bucket, give_back, memory_for, remembers, ship_code, staged
from reportloom.plans.staging import dropped_afterwards

#: Bounds of the labelled sample on which the field is fitted: documents of each class, and their characters in all. A word
#: and the space behind it have two characters at least, so a class has at most half as many words.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 4_000_000
#: Buckets for hashed words; words remembered by a worker; words judged together; steps of a block.
BUCKETS, REMEMBERED, TOGETHER, STEPS = 1 << 18, 400_000, 1 << 17, 512
#: Lengths of the beginnings of a word that are keys of their own, so that forms of one stem are known by it.
BEGINNINGS = (4, 5, 6, 7)
#: What makes a key telling: the share of toxic documents among those that hold it (both classes weighing alike), the share of
#: toxic documents that hold it, and the least number of them.
SURE, COMMON, LEAST = 0.95, 0.01, 4
ROUNDS, RATE, RIDGE = 40, 0.3, 2e-6

_WORD = re.compile(r"\S+")
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»¿¡…“”‘’"


def plain_word(word: str) -> str:
    return word.lower().strip(_EDGES)


def keys(word: str) -> list[str]:
    """What a word is known by: itself and its beginnings; longer beginnings than the word are the word."""
    plain = plain_word(word)
    return [plain, *("^" + plain[:k] for k in BEGINNINGS)] if plain else []


class Features:
    """The buckets of each word's keys, hashed once and remembered by the worker."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED, 1 + len(BEGINNINGS)), np.int32)

    def of(self, words: list[str]) -> np.ndarray:
        """One row of buckets for each word; bucket 0 stands for no key."""
        if len(self.rows) + len(words) > REMEMBERED:
            self.rows.clear()
        found = list(map(self.rows.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, row in zip(words, found, strict=True) if row is None))
            if len(self.rows) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(new), self.table.shape[1]), np.int32)])
            for word in new:
                row = self.rows[word] = len(self.rows)
                for k, key in enumerate(keys(word)):
                    self.table[row, k] = 1 + zlib.crc32(key.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
                if not plain_word(word):
                    self.table[row] = 0
            found = list(map(self.rows.__getitem__, words))
        return self.table[np.array(found, np.int64)] if words else self.table[:0]


_features = Features()
remembers("toxicity", _features.__init__)


@dataclass
class Field:
    """Weights of a two-state chain (0 clean, 1 toxic): of the keys of the word, of the word before and after, of steps and starts."""

    words: np.ndarray = field(default_factory=lambda: np.zeros((3 + len(BEGINNINGS), BUCKETS), np.float32))
    steps: np.ndarray = field(default_factory=lambda: np.array([[2.0, -2.0], [0.0, 0.0]]))
    start: np.ndarray = field(default_factory=lambda: np.array([0.0, -2.0]))
    #: The document's score is the logistic of slope * logit(largest marginal) + level.
    slope: float = 1.0
    level: float = 0.0


def with_neighbours(rows: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Buckets of each word's keys, and of the words before and after within its document."""
    before = np.concatenate([[0], rows[:-1, 0]])
    before[first] = 0
    after = np.concatenate([rows[1:, 0], [0]])
    after[:-1][first[1:]] = 0
    return [*rows.T, before, after]


def forward_backward(gain: np.ndarray, first: np.ndarray, model: Field) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state, and the expected counts of the steps, of documents laid end to end.

    ``gain`` is what a word's features give the toxic state, ``first`` marks where documents begin. The words are laid out
    in blocks that advance side by side: products of step matrices carry a block's beginning to its end, the
    ends are chained one after another, and a second pass fills the blocks. A document's first word forgets what was before.
    """
    n = len(gain)
    blocks = -(-n // STEPS)
    lift = np.exp(np.clip(np.pad(gain, (0, blocks * STEPS - n)), -30, 30)).reshape(blocks, STEPS)
    opens = np.pad(first, (0, blocks * STEPS - n), constant_values=True).reshape(blocks, STEPS)
    step, start = np.exp(model.steps), np.exp(model.start)
    # m[i][j]: from state i before to state j at this word.
    m = [
        [np.where(opens, start[j], step[i, j]) * (lift if j else np.ones_like(lift)) for j in (0, 1)] for i in (0, 1)
    ]
    p = [[np.ones(blocks), np.zeros(blocks)], [np.zeros(blocks), np.ones(blocks)]]
    for t in range(STEPS):
        p = [[p[i][0] * m[0][j][:, t] + p[i][1] * m[1][j][:, t] for j in (0, 1)] for i in (0, 1)]
        scale = p[0][0] + p[0][1] + p[1][0] + p[1][1]
        p = [[x / scale for x in row] for row in p]
    p00, p01, p10, p11 = (p[i][j].tolist() for i in (0, 1) for j in (0, 1))
    into, a0, a1 = [], 1.0, 0.0
    for b in range(blocks):
        into.append((a0, a1))
        a0, a1 = a0 * p00[b] + a1 * p10[b], a0 * p01[b] + a1 * p11[b]
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    outof, b0, b1 = [(1.0, 1.0)] * blocks, 1.0, 1.0
    for b in range(blocks - 1, -1, -1):
        outof[b] = (b0, b1)
        b0, b1 = p00[b] * b0 + p01[b] * b1, p10[b] * b0 + p11[b] * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    alpha = np.empty((2, STEPS + 1, blocks))
    alpha[:, 0] = np.array(into).T
    for t in range(STEPS):
        x0 = alpha[0, t] * m[0][0][:, t] + alpha[1, t] * m[1][0][:, t]
        x1 = alpha[0, t] * m[0][1][:, t] + alpha[1, t] * m[1][1][:, t]
        alpha[0, t + 1], alpha[1, t + 1] = x0 / (x0 + x1), x1 / (x0 + x1)
    beta = np.empty((2, STEPS + 1, blocks))
    beta[:, STEPS] = np.array(outof).T
    for t in range(STEPS - 1, -1, -1):
        y0 = m[0][0][:, t] * beta[0, t + 1] + m[0][1][:, t] * beta[1, t + 1]
        y1 = m[1][0][:, t] * beta[0, t + 1] + m[1][1][:, t] * beta[1, t + 1]
        beta[0, t], beta[1, t] = y0 / (y0 + y1), y1 / (y0 + y1)
    both = alpha[:, 1:] * beta[:, 1:]
    marginal = (both[1] / both.sum(0)).T.reshape(-1)[:n]
    pairs = np.empty((2, 2, blocks, STEPS))
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = alpha[i, :-1].T * m[i][j] * beta[j, 1:].T
    pairs /= pairs.sum((0, 1))
    inner = ~opens
    inner.reshape(-1)[n:] = False
    return marginal, (pairs * inner).sum((2, 3))


def laid_out(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, whether each begins a document, and the documents' lengths."""
    lengths = np.array([len(words) for words in texts], np.int64)
    rows = _features.of([word for words in texts for word in words])
    first = np.zeros(len(rows), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return rows, first, lengths


def marginals(rows: np.ndarray, first: np.ndarray, model: Field) -> np.ndarray:
    if not len(rows):
        return np.zeros(0)
    gain = sum(table[part] for table, part in zip(model.words, with_neighbours(rows, first), strict=True))
    return forward_backward(gain.astype(np.float64), first, model)[0]


def largest(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The largest value of each document, 0 for one without words."""
    out = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        out[some] = np.maximum.reduceat(values, (np.cumsum(lengths) - lengths)[some])
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def doc_scores(values: np.ndarray, lengths: np.ndarray, model: Field) -> np.ndarray:
    return 1 / (1 + np.exp(-(model.slope * _logit(largest(values, lengths)) + model.level)))


def unlike(sketches: list[bytes]) -> list[int]:
    """Places of documents whose sketch shares less than half with those taken before.

    Copies would make every word of a copied document look as telling as its label.
    """
    seen: set[int] = set()
    out = []
    for k, packed in enumerate(sketches):
        sketch = np.frombuffer(packed, np.uint32).tolist()
        if 2 * len(seen.intersection(sketch)) < len(sketch):
            out.append(k)
            seen.update(sketch)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each labelled text the crc32 of every word's keys (zeros for none) and the least of its five-word runs' crc32."""
    for batch in batches:
        for text, rest in zip(batch.column("text").to_pylist(), (batch.slice(k, 1) for k in range(batch.num_rows)), strict=True):
            words = _WORD.findall(text)
            known: dict[str, list[int]] = {}
            for word in set(words):
                codes = [zlib.crc32(key.encode("utf-8", "surrogatepass")) for key in keys(word)]
                known[word] = codes or [0] * (1 + len(BEGINNINGS))
            codes = np.array([known[w] for w in words], np.uint32)
            runs = {zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}
            sketch = np.array(sorted(runs)[:16], np.uint32)
            yield pa.RecordBatch.from_arrays(
                [rest.column("__id"), rest.column("toxic"), pa.array([codes.tobytes()], pa.binary()), pa.array([sketch.tobytes()], pa.binary())],
                names=["__id", "toxic", "codes", "sketch"],
            )


def _telling(codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rate: list[int]) -> np.ndarray:
    """The keys that many toxic and hardly any clean documents of the sample hold, in order."""
    ends, counts = np.cumsum(lengths), []
    for y in (True, False):
        held = [np.unique(codes[end - n : end]) for end, n, label in zip(ends.tolist(), lengths.tolist(), labels.tolist(), strict=True) if label == y]
        found, n = np.unique(np.concatenate(held), return_counts=True)
        counts.append((found[found != 0], n[found != 0]))
    (found, n), (clean, m) = counts
    some = n >= max(LEAST, COMMON * rate[1])
    found, n = found[some], n[some]
    if not len(found) or not len(clean):
        return found
    at = np.minimum(np.searchsorted(clean, found), len(clean) - 1)
    others = np.where(clean[at] == found, m[at], 0)
    return found[n / rate[1] >= SURE * (n / rate[1] + others / rate[0])]


def _portions(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole documents of some TOGETHER words each, as places of their first document and behind their last."""
    ends = np.cumsum(lengths)
    out, begin = [], 0
    while begin < len(lengths):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        out.append((begin, end))
        begin = end
    return out


def fit(sample: list, toxic_share: float = 0.5) -> Field | None:
    """Fit the field to documents with labels (``toxic``, ``codes``, ``sketch``); None without both classes or any telling key.

    ``toxic_share`` is the share of toxic labels outside the sample, which may draw the classes unevenly. ``sample`` is
    emptied. It is kept as flat numbers, some 25 bytes a word, and the sums run over some TOGETHER words at a time.

    Labelled tokens: a word is a toxic token, within toxic documents, if it or one of its beginnings is telling, which
    means that many toxic and hardly any clean documents of the sample hold it.
    Weights follow the gradient of the penalised likelihood (expected against labelled counts), by Adam.
    """
    chosen = [sample[k] for k in unlike([row["sketch"] for row in sample])]
    sample.clear()
    labels = np.array([row["toxic"] for row in chosen], bool)
    if labels.all() or not labels.any():
        return None
    # Both classes weigh alike, however many documents the sample has of each.
    rate = [max(1, int((labels == y).sum())) for y in (False, True)]
    lengths = np.array([len(row["codes"]) // (4 * (1 + len(BEGINNINGS))) for row in chosen], np.int64)
    codes = np.frombuffer(b"".join([row["codes"] for row in chosen]), np.uint32).reshape(-1, 1 + len(BEGINNINGS))
    del chosen
    telling = _telling(codes, lengths, labels, rate)
    if not len(telling):
        return None
    ends = np.cumsum(lengths)
    spans = [(int(ends[b] - lengths[b]), int(ends[e - 1])) for b, e in _portions(lengths) if lengths[b:e].any()]
    ids = np.empty(codes.shape, np.int32)
    first, wanted, in_toxic = np.zeros(len(ids), bool), np.zeros(len(ids), bool), np.repeat(labels, lengths)
    first[(ends - lengths)[lengths > 0]] = True
    for a, b in spans:
        own = codes[a:b]
        ids[a:b] = np.where(own.any(1)[:, None], 1 + own % np.uint32(BUCKETS - 1), 0)
        at = np.minimum(np.searchsorted(telling, own), len(telling) - 1)
        wanted[a:b] = (telling[at] == own).any(1) & in_toxic[a:b]
    del codes
    model = Field()
    again = np.zeros((2, 2))
    for a, b in spans:
        pairs = wanted[a : b - 1].astype(int) * 2 + wanted[a + 1 : b].astype(int)
        again += np.bincount(pairs[~first[a + 1 : b]], minlength=4).reshape(2, 2)
    starts = np.array([(~wanted[first]).sum(), wanted[first].sum()])
    moments = [[np.zeros_like(x, float) for x in (model.words, model.steps, model.start)] for _ in range(2)]
    for turn in range(1, ROUNDS + 1):
        grads = [-RIDGE * len(ids) * model.words.astype(float), again.copy(), starts.astype(float)]
        for a, b in spans:
            parts = with_neighbours(ids[a:b], first[a:b])
            gain = sum(table[part] for table, part in zip(model.words, parts, strict=True)).astype(float)
            marginal, pairs = forward_backward(gain, first[a:b], model)
            off, opening = wanted[a:b] - marginal, marginal[first[a:b]]
            for row, part in zip(grads[0], parts, strict=True):
                row += np.bincount(part, weights=off, minlength=BUCKETS)
            grads[1] -= pairs
            grads[2] -= np.array([(1 - opening).sum(), opening.sum()])
        for place, (name, g) in enumerate(zip(("words", "steps", "start"), grads, strict=True)):
            m, v = moments[0][place], moments[1][place]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value = getattr(model, name)
            move = m / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
            move *= RATE * (0.5 if place else 1) / (1 - 0.9**turn)
            setattr(model, name, (value + move).astype(value.dtype))
    model.words[:, 0] = 0
    # Scores: a logistic line over the largest marginal, the classes weighing as among all labels, by Newton's method.
    most = np.zeros(len(labels))
    for begin, end in _portions(lengths):
        a, b = int(ends[begin] - lengths[begin]), int(ends[end - 1])
        most[begin:end] = largest(marginals(ids[a:b], first[a:b], model), lengths[begin:end])
    x = _logit(most) / 10
    y, weight = labels.astype(float), np.where(labels, toxic_share / rate[1], (1 - toxic_share) / rate[0]) * len(labels)
    line, rows = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-rows @ line))
        slope = rows.T @ (weight * (y - p)) - 0.1 * line
        line = line + np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(2), slope)
    model.slope, model.level = float(line[0]) / 10, float(line[1])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, chars: int, folds: int, held_out: int, id_col: str, text_col: str):
    """Keys of at most ``rows`` texts of each class with an even draw by id, out of the folds that may be learnt from; the toxic share.

    Texts are taken along the draw as long as the class has at most ``chars`` characters; they become keys in tasks, and
    only those come to the driver.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(crc_bucket(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    draw = F.xxhash64("doc_id", F.lit(11))
    drawn = None
    for label in (0, 1):
        own = known.where(F.col("toxic") == label).orderBy(draw, "doc_id").limit(rows)
        drawn = own if drawn is None else drawn.union(own)
    drawn = staged(drawn.withColumnRenamed("doc_id", "__id"), "toxic-drawn")
    texts = docs.select(docs[id_col].alias("__doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = texts.join(F.broadcast(drawn), F.col("__doc") == F.col("__id"))
    sizes = found.groupBy("__id", "toxic").agg(F.max(F.char_length("text")).alias("size"))
    # At most two times ``rows`` ids and sizes.
    passed = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("__id", F.lit(11)), "__id"))
    taken = staged(sizes.withColumn("passed", passed).where(F.col("passed") <= chars).select("__id"), "toxic-taken")
    sample = found.join(F.broadcast(taken), "__id", "left_semi").select("__id", "text", "toxic")
    # Of rows that share an id one text counts, the smallest.
    sample = sample.groupBy("__id", "toxic").agg(F.min("text").alias("text"))
    kind, label = (sample.schema[c].dataType.simpleString() for c in ("__id", "toxic"))
    packed = sample.mapInArrow(_packed, f"__id {kind}, toxic {label}, codes binary, sketch binary")
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    return sorted(packed.collect(), key=lambda row: (str(type(row["__id"])), row["__id"])), share


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    memory_for("toxicity")
    model: Field | None = shared.value
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        texts = batch.column("text").to_pylist()
        begin = 0
        while begin < len(texts):
            # Whole documents, until their words fill a round.
            split, held, end = [], 0, begin
            while end < len(texts) and held < TOGETHER:
                split.append(texts[end].split())
                held += len(split[-1])
                end += 1
            if model is None:
                scores, spans = np.zeros(end - begin), [[]] * (end - begin)
            else:
                ids, first, lengths = laid_out(split)
                values = marginals(ids, first, model)
                scores, spans, at = doc_scores(values, lengths, model), [], 0
                for text, n in zip(texts[begin:end], lengths.tolist(), strict=True):
                    hit = set(np.flatnonzero(values[at : at + n] >= 0.5).tolist())
                    found = (m.span() for k, m in enumerate(_WORD.finditer(text)) if k in hit) if hit else ()
                    spans.append([{"start": s, "end": e} for s, e in found])
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(begin, end - begin), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                names=["doc_id", "score", "spans"],
            )
            begin = end


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    held_out: int = 1,
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``spans`` of words tagged toxic (code points).

    Labels (``doc_id``, ``toxic``) are learnt only from documents whose crc32 of the id's text modulo ``folds`` is not
    ``held_out``, at most ``sample_rows`` with ``sample_chars`` characters of each class, drawn by a hash of the id; near copies in
    the sample count once. The
    field's weights (some megabytes, whatever the corpus) are broadcast; forward and backward sums give each word's
    marginal, the largest one gives the score.

    A word is what stands between white space; case and signs around it do not matter. Null and empty text have the score of
    no marginal; a null id is in no fold to be learnt from and not held out unless its empty text's remainder says so; repeated rows score
    alike; several labels of one id count as toxic if one is; without both classes in the sample every score is 0. An
    empty table gives an empty table; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with dropped_afterwards(spark):
        sample, share = labelled_sample(docs, labels, sample_rows, sample_chars, folds, held_out, id_col, text_col)
    shared = spark.sparkContext.broadcast(fit(sample, share))
    give_back()
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(
        lambda batches: _score(batches, shared), f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>"
    )
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", "spans")


def _below(batches: Iterator[pa.RecordBatch], shared, text_at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text_at).cast(pa.string()).fill_null("")
        rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), texts], names=["doc_id", "text"])
        scores = np.concatenate([np.zeros(0), *(part.column("score").to_numpy() for part in _score(iter([rows]), shared))])
        yield batch.filter(pa.array(scores < threshold))


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    folds: int = 3,
    held_out: int = 1,
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns.

    Every row is judged by its own text where it stands, so rows that share an id, or have none, are kept or dropped each
    on its own; no column's name matters. Otherwise as ``toxicity``.
    """
    ship_code(docs.sparkSession)
    with dropped_afterwards(docs.sparkSession):
        sample, share = labelled_sample(docs, labels, sample_rows, sample_chars, folds, held_out, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample, share))
    give_back()
    place = docs.columns.index(text_col)
    return docs.mapInArrow(lambda batches: _below(batches, shared, place, threshold), docs.schema)
