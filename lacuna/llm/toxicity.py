"""Toxicity by maximum-scoring segments.

Every word, and every stem (a word's first four or five bytes, for words seen too rarely
themselves), has a log-odds weight between toxic and clean labelled documents, shrunk by
an informative Dirichlet prior and taken at the cautious end of its interval; near
copies count once. Scripts that put no spaces between words are cut into
pairs of characters. A word's step is its own or its stems' best weight. Along a
text, weights less a constant drift make a walk whose maximal rising segments (all of
them, in linear time) are its suspicious passages. How high a passage rises by chance in
a clean text of that length follows an extreme-value law with parameters lambda and K;
passages beyond it are significant. A text's evidence is turned into a probability by
a logistic fit on labelled texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime
from .jaccard import WordHashes, mix, shingles
from .runtime import BROADCAST_BYTES, arrow_map, chunks, join_counted, materialize, spread, unused

#: Labelled rows, the first in the order of a hash of their ids, that the extreme-value law and the logistic fit see.
FIT_ROWS = 20_000
#: Strength of the Dirichlet prior, as a share of all counts; width of the interval, in standard errors; smallest weight kept; loss at each step.
PRIOR, WIDTH, LEAST, DRIFT = 1 / 300, 1.5, 1.0, 0.05
#: Labelled texts are near copies, and count once, from this similarity, in hundredths, of their shingles of so many words; they meet under so many smallest hashes.
FAMILY_PERCENT, FAMILY_WORDS, FAMILY_HASHES = 80, 3, 3
#: A passage counts if its chance in a clean text is below this.
SIGNIFICANT = 0.05

# ASCII letters are lower-cased, other ASCII characters than letters and digits separate words.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
# Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")


def _pairs(run: re.Match) -> str:
    found = run.group()
    return " " + " ".join(found[i : i + 2] for i in range(max(1, len(found) - 1))) + " "


def words(text: str | None) -> list[bytes]:
    if not text:
        return []
    if not text.isascii():
        text = _UNSPACED.sub(_pairs, text)
    return text.encode().translate(_LOWER).split()


def features(word: bytes) -> list[bytes]:
    """A word, a long one by its digest, and its stems; no word holds the marks of a digest or a stem."""
    out = [word if len(word) <= 64 else b"#" + xxhash.xxh3_128_digest(word)]
    if len(word) > 4:
        out.append(word[:4] + b"*")
    if len(word) > 5:
        out.append(word[:5] + b"*")
    return out


class Steps(dict):
    """The step of each word, worked out once while there is room."""

    def __init__(self, weights: dict[bytes, float], drift: float):
        super().__init__()
        self.weights, self.drift = weights, drift

    def __missing__(self, word: bytes) -> float:
        known = [self.weights[f] for f in features(word) if f in self.weights]
        step = (max(known) if max(known) > 0 else min(known)) - self.drift if known else -self.drift
        if len(self) > 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = step
        return step


def maximal_segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a walk, in order, in linear time.

    Each is a run that no neighbouring run could raise: the list kept so far holds
    candidates with the walk's height before and after them; a new rise is merged to the
    left while it tops what came after an earlier candidate that starts lower.
    """
    up = np.flatnonzero(weights > 0)
    if not up.size:
        return []
    height = np.concatenate(([0.0], np.cumsum(weights)))
    found: list[list] = []  # start, end, height before, height after, index of the last one that starts lower
    for i in up.tolist():
        start, end, low, high = i, i + 1, height[i], height[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([start, end, low, high, j])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, float(hi - lo)) for s, e, lo, hi, _ in found]


@dataclass
class Model:
    """Word weights, the extreme-value law, and the logistic fit."""

    weights: dict[bytes, float]
    drift: float
    lam: float
    log_k: float
    center: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    #: Where the weights are, if they are too many for a worker; each text then comes with its own.
    path: str | None = None
    steps: Steps | None = None

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and every maximal segment (first word, end, score)."""
        seen = words(text)
        if not seen:
            return 0, []
        if self.steps is None:
            self.steps = Steps(self.weights, self.drift)
        return len(seen), maximal_segments(np.fromiter(map(self.steps.__getitem__, seen), float, len(seen)))

    def log_chance(self, n: float, score: float) -> float:
        """Log of the chance that a clean text of n words holds a segment of that score."""
        expected = self.log_k + np.log(n) - self.lam * score
        return float(expected if expected < -20 else np.log(-np.expm1(-np.exp(min(expected, 5.0)))))

    def evidence(self, n: float, scores: list[float]) -> list[float]:
        """The surest passage, all significant ones together, and their density."""
        if not scores:
            return [0.0, 0.0, 0.0]
        chances = [-self.log_chance(n, s) for s in scores]
        sure = sum(c for c in chances if c > -np.log(SIGNIFICANT))
        return [float(np.log1p(max(chances))), float(np.log1p(sure)), float(sure / np.sqrt(n))]

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Probability of label 1, and all segments with the log of their chance."""
        n, found = self.segments(text)
        return self.probability(self.evidence(n, [x[2] for x in found])), [(*x, self.log_chance(n, x[2])) for x in found]

    def probability(self, evidence: list[float]) -> float:
        z = self.coef[0] + float(((np.array(evidence) - self.center) / self.scale) @ self.coef[1:])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _families(rows: DataFrame) -> DataFrame:
    """The rows (label, text, __id), less confirmed near copies of an earlier row with the same label.

    Rows meet the first one that shares one of a few smallest shingle hashes with them,
    and go if their exact Jaccard similarity with it reaches ``FAMILY_PERCENT`` hundredths. What only meets stays.
    """
    marked = T.StructType([*rows.schema.fields, T.StructField("row", T.LongType()), T.StructField("least", T.ArrayType(T.LongType()))])
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    at, names = numbered.columns.index("text"), numbered.columns

    def mark(batches):
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            least = []
            for text in batch.column(at).to_pylist():
                found = shingles(text, FAMILY_WORDS, hashes)
                least.append([int(mix(found + np.uint64(i)).min().view(np.int64)) for i in range(FAMILY_HASHES)] if len(found) else None)
            yield {n: batch.column(i) for i, n in enumerate(names)} | {"least": least}

    labelled = materialize(arrow_map(spread(numbered), mark, marked), "labelled")
    met = labelled.select("row", "label", F.posexplode("least").alias("i", "least"))
    first = met.groupBy("label", "i", "least").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    pairs = join_counted(met, materialize(first, "first-rows"), ["label", "i", "least"]).where("row <> first").select("row", "first").distinct()
    pairs = materialize(pairs, "first-pairs")
    # A first row that many meet is compared in several tasks.
    share = materialize(pairs.groupBy("first").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / 500).cast("int").alias("shares")), "first-shares")
    own = join_counted(pairs, share, ["first"]).withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int"))
    texts = labelled.select("row", "text")
    own = own.join(texts, "row").select("first", "share", "row", "text")
    firsts = share.select("first", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    firsts = firsts.join(texts.select(F.col("row").alias("first"), F.col("text").alias("first_text")), "first")

    def confirm(batches):
        hashes, last, held = WordHashes(), None, None
        for batch in chunks(batches, "text", 2 << 20):
            gone = []
            for first, text, row, other in zip(*(c.to_pylist() for c in batch.columns)):
                if first != last:
                    last, held = first, shingles(other, FAMILY_WORDS, hashes)
                found = shingles(text, FAMILY_WORDS, hashes)
                common = len(np.intersect1d(found, held, assume_unique=True))
                if 100 * common >= FAMILY_PERCENT * (len(found) + len(held) - common):
                    gone.append(row)
            yield {"row": gone}

    compared = own.join(firsts, ["first", "share"]).select("first", "text", "row", "first_text")
    gone = materialize(arrow_map(compared, confirm, T.StructType([T.StructField("row", T.LongType())])).distinct(), "near-copies")
    if gone.count() * 64 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return labelled.join(gone, "row", "left_anti").select("label", "text", "__id")


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): rows of either label that hold the word or stem."""
    schema = T.StructType([T.StructField("feature", T.BinaryType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])

    def run(batches):
        counts: dict[bytes, list[int]] = {}

        def flush():
            out = {"feature": [*counts], "toxic": [x[1] for x in counts.values()], "clean": [x[0] for x in counts.values()]}
            counts.clear()
            return out

        for batch in chunks(batches, "text"):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in set(words(text)) for f in features(w)}:
                    if f in counts:
                        counts[f][label] += 1
                    else:
                        counts[f] = [1 - label, label]
                if len(counts) > 150_000:
                    yield flush()
        yield flush()

    return arrow_map(rows.select("text", "label"), run, schema).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _weights(rows: DataFrame) -> DataFrame:
    """(feature, w, rows): the cautious log-odds of all words and stems that have one."""
    counts = materialize(_counts(rows), "word-counts")
    total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    t1, t0 = float(total[0] or 0), float(total[1] or 0)
    strength = PRIOR * (t1 + t0)
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean"))
    y1, y0 = F.col("toxic") + prior + 0.01, F.col("clean") + prior + 0.01
    odds = F.log(y1 / (F.lit(t1 + strength) - y1 + 1)) - F.log(y0 / (F.lit(t0 + strength) - y0 + 1))
    error = F.sqrt(1 / y1 + 1 / y0)
    scored = counts.select("feature", (F.col("toxic") + F.col("clean")).alias("rows"), (F.signum(odds) * (F.abs(odds) - WIDTH * error)).alias("w"), (F.abs(odds) / error).alias("z"))
    scored = scored.where((F.abs("w") >= LEAST) & (F.col("z") > WIDTH) & F.lit(bool(t1 and t0)))
    return materialize(scored.select("feature", "w", "rows"), "word-weights")


def _with_weights(rows: DataFrame, text_col: str, model: Model) -> DataFrame:
    """The rows, each with a last column of its own words' weights if the model's are too many to broadcast."""
    if model.path is None:
        return rows
    row, own = unused(rows, "row", "weights")
    numbered = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "numbered")
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("feature", T.BinaryType())])

    def run(batches):
        for batch in chunks(batches, "text", 1 << 20):
            out: dict = {"row": [], "feature": []}
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {f for w in set(words(text)) for f in features(w)}
                out["feature"] += found
                out["row"] += [at] * len(found)
            yield out

    pairs = arrow_map(numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text")), run, schema)
    hits = join_counted(pairs, rows.sparkSession.read.parquet(model.path), ["feature"])
    hits = hits.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("feature", "w")).alias(own))
    return numbered.join(hits, row, "left").select(*rows.columns, own)


def _walkers(model: Model, batch: pa.RecordBatch):
    """A model for each row: the shared one, or one with the weights in the row's last column."""
    if model.path is None:
        return repeat(model)
    lists = batch.column(batch.num_columns - 1).to_pylist()
    return (replace(model, weights={x["feature"]: x["w"] for x in found or ()}, steps=None) for found in lists)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic fit with intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _extreme_value(highs: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    """lambda and log K from clean texts' highest segments: moments of the Gumbel law of score less log size over lambda."""
    some = highs > 0
    if some.sum() < 20:
        return 1.0, 0.0
    log_n, m = np.log(sizes[some]), highs[some]
    lam = 1.0
    for _ in range(50):
        width = np.std(m - log_n / lam)
        new = float(np.clip(np.pi / (np.sqrt(6) * max(width, 1e-3)), 0.05, 20.0))
        if abs(new - lam) < 1e-6:
            break
        lam = (lam + new) / 2
    share = some.mean()
    mean = float(np.mean(m - log_n / lam))
    return lam, lam * mean - 0.5772156649 + float(np.log(share))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from documents with a label of 0 or 1; with only one kind, every text gets its share.

    Word counts use all labelled rows, near copies once; the extreme-value and the logistic fit use at most
    ``FIT_ROWS`` of the ids, with one text each (the smallest, if an id repeats). Ids serve to join labels and
    order that choice, nothing else. An id with both labels has label 1; labels that are neither or
    have no id are left out. Other columns are not read.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    if labels.count() * 64 <= BROADCAST_BYTES:
        marks = F.broadcast(marks)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(marks, "__id").select("text", "label", "__id")
    weights = _weights(_families(rows))
    model = Model({}, DRIFT, 1.0, 0.0, np.zeros(3), np.ones(3), np.zeros(4))
    if (weights.agg(F.sum(F.octet_length("feature") + 160)).first()[0] or 0) <= runtime.BROADCAST_BYTES:
        model.weights = {bytes(r.feature): float(r.w) for r in weights.collect()}
    else:
        model.path = weights._scratch
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def walk(batches):
        held = shared.value
        for batch in chunks(batches, "text"):
            sizes, scores = [], []
            for own, text in zip(_walkers(held, batch), batch.column(1).to_pylist()):
                n, found = own.segments(text)
                sizes.append(n)
                scores.append([x[2] for x in found])
            yield {"label": batch.column(0), "n": sizes, "scores": scores}

    ids = rows.select(F.xxhash64("__id").alias("h"), "__id").distinct().orderBy("h", "__id").limit(FIT_ROWS)
    last = ids.agg(F.max(F.struct("h", "__id"))).first()[0]
    if last is None:
        model.coef = np.array([-20.0, 0, 0, 0])
        return model
    inside = F.struct(F.xxhash64("__id").alias("h"), "__id") <= F.struct(F.lit(last[0]).alias("h"), F.lit(last[1]).alias("__id"))
    chosen = rows.where(inside).groupBy("__id", "label").agg(F.min("text").alias("text")).select("label", "text")
    got = arrow_map(_with_weights(chosen, "text", model), walk, schema).toArrow()
    label = np.array(got.column("label").to_pylist(), float)
    sizes = np.array(got.column("n").to_pylist(), float)
    scores = got.column("scores").to_pylist()
    clean = (label == 0) & (sizes > 0)
    model.lam, model.log_k = _extreme_value(np.array([max(s, default=0.0) for s in scores])[clean], sizes[clean])
    x = np.array([model.evidence(n, s) for n, s in zip(sizes, scores)])
    model.center, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    share = (label.sum() + 0.5) / (len(label) + 1)
    if 0 < label.sum() < len(label):
        model.coef = _logistic((x - model.center) / model.scale, label)
    else:
        model.coef = np.array([np.log(share / (1 - share)), 0, 0, 0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1), predicted (score >= 0.5) and the significant passages.

    Passages are (first word, end word, score, log of the chance). A null text is an empty
    one and has no passages; ids may be null or repeat; an empty table gives no rows.
    """
    part = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("log_chance", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(part))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        held = shared.value
        limit = np.log(SIGNIFICANT)
        for batch in chunks(batches, "text"):
            out: dict = {"score": [], "predicted": [], "passages": []}
            for own, text in zip(_walkers(held, batch), batch.column(1).to_pylist()):
                p, found = own.judge(text)
                out["score"].append(p)
                out["predicted"].append(int(p >= 0.5))
                out["passages"].append([dict(zip(("start", "end", "score", "log_chance"), x)) for x in found if x[3] < limit])
            yield out | {"doc_id": batch.column(0)}

    return arrow_map(spread(_with_weights(rows, "text", model)), run, schema)


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not predict toxic, with all their columns, whatever their names.

    Null and empty texts and repeated rows are judged like any other; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        held = shared.value
        for batch in chunks(batches, text_col):
            keep = [own.judge(x)[0] < 0.5 for own, x in zip(_walkers(held, batch), batch.column(at).to_pylist())]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield {name: kept.column(i) for i, name in enumerate(names)}

    return arrow_map(_with_weights(docs, text_col, model), run, docs.schema)
