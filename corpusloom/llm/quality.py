"""Quality classifier: document evidence with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import cut_lineage, few
from .jaccard_join import shingles
from .rows import without
from .words import split_words, texts

#: Labelled rows that the document classifier is fitted on, at most; drawn by a hash of the id.
LABELLED_ROWS = 20_000
#: Words and word beginnings kept as signs of a label, and the likelihood ratio (G2) that they have to reach.
SIGNS = 2_000
LEAST_G2 = 40.0
#: Of the documents with a sign, the share that has the label.
PURE = 0.7
PREFIXES = (4, 5, 6)
PENALTY = 1.0

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGITS = bytes(range(0x30, 0x3A))
_STOPS = b".,;:'\"?()-"
_OTHER = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in _STOPS)
SHAPE = ["log_words", "word_length", "distinct", "repeated", "upper", "digits", "stops", "symbols", "symbol_words", "line_words"]


def shape(text: bytes) -> list[float]:
    """Figures of the whole text that need no vocabulary: its characters by kind, repetition and lengths."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    share = lambda kind: 1 - len(text.translate(None, kind)) / size
    symbols = share(_OTHER)
    return [
        float(np.log1p(len(words))), min(30.0, size / n) / 10, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        share(_UPPER), share(_DIGITS), share(_STOPS), symbols, min(2.0, symbols * size / n), float(np.log1p(n / (text.count(b"\n") + 1))),
    ]


def signs_of(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings marked by a space."""
    letters = word.decode("utf-8", "replace")
    return [word, *(b" " + letters[:n].encode() for n in PREFIXES if len(letters) > n)]


class Evidence(dict):
    """word -> the weight of its strongest sign; forgets all when it holds ``limit`` words."""

    def __init__(self, weights: dict[bytes, float], limit: int = 100_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = max(self.weights.get(x, 0.0) for x in signs_of(word))
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: set[bytes]) -> float:
        return float(np.log1p(sum(map(self.__getitem__, words)))) if self.weights else 0.0


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """doc_id, text, bad (quality 0) and toxic of at most ``rows`` labelled documents."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"), F.max("toxic").alias("toxic"))
        .where("bad IS NOT NULL AND toxic IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(rows)
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def _counted(sample: DataFrame) -> DataFrame:
    """sign, n, bad, toxic: how many documents hold each word or beginning, of all, bad and toxic ones.

    Of documents with the same least shingle only one counts, so that copies don't make their words look like signs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad, toxic = Counter(), Counter(), Counter()
        for batch in batches:
            for text, b, t in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = {x for w in set(split_words(text)) for x in signs_of(w)}
                n.update(found)
                if b:
                    bad.update(found)
                if t:
                    toxic.update(found)
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (n, bad, toxic))], ["sign", "n", "bad", "toxic"]
        )

    return sample.select("text", "bad", "toxic").mapInArrow(run, "sign binary, n long, bad long, toxic long").groupBy("sign").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("toxic").alias("toxic")
    )


def _least_shingle(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [int(s[:1].view(np.int64)[0]) if len(s) else 0 for s in map(shingles, texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["doc_id", "text", "bad", "toxic", "least"])

    return sample.select("doc_id", "text", "bad", "toxic").mapInArrow(run, "doc_id long, text string, bad int, toxic int, least long")


def _strongest(counted: DataFrame, label: str, total: int, positive: int) -> dict[bytes, float]:
    """Signs that come with the label far more often than without, with their log odds; SIGNS rows at most."""
    a, n = F.col(label).cast("double"), F.col("n").cast("double")
    p, q = positive / max(1, total), (a + 0.5) / (n + 1)
    term = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    rows = (
        counted.where((a >= PURE * n) & (q > 1.5 * p) & (n > 0))
        .select("sign", (F.log(q / (1 - q)) - float(np.log(max(p, 1e-9) / max(1e-9, 1 - p)))).alias("w"), (2 * (term(a, F.lit(max(p, 1e-9))) + term(n - a, F.lit(max(1e-9, 1 - p))))).alias("g2"))
        .where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "sign").limit(SIGNS).toArrow()
    )
    return dict(zip(rows.column("sign").to_pylist(), rows.column("w").to_pylist(), strict=True))


def described(text: bytes | None, bad: Evidence, toxic: Evidence) -> list[float]:
    words = set(split_words(text))
    return [*shape(text or b""), bad.of(words), toxic.of(words)]


def _features(sample: DataFrame, bad: dict[bytes, float], toxic: dict[bytes, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Evidence(bad), Evidence(toxic)
        for batch in batches:
            x = [described(text, *signs) for text in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "bad", "toxic"])

    return sample.select("text", "bad", "toxic").mapInArrow(run, "x array<double>, bad int, toxic int")


def expand(x: np.ndarray) -> np.ndarray:
    """The figures, their squares and a constant."""
    return np.hstack([x, x[:, : len(SHAPE)] ** 2, np.ones((len(x), 1))])


def fit(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Logistic regression by damped Newton steps with a quadratic penalty on standardised columns."""
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1])
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return w
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[-1] = 0, 1
    scale[scale < 1e-9] = 1
    z, w, penalty = (x - mean) / scale, np.zeros(x.shape[1]), np.full(x.shape[1], PENALTY)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        s = z @ w
        return float(np.logaddexp(0, s).sum() - s @ y + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6:
            break
    out = w / scale
    out[-1] = w[-1] - (w[:-1] * mean[:-1] / scale[:-1]).sum()
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS) -> dict:
    """The document classifier: signs and weights for bad quality and for toxicity.

    Fitted on ``rows`` labelled documents at most, one of each group of near copies.
    Nulls in a label leave its row out; a document labelled more than once counts as bad or
    toxic if one label says so. Without labels the classifier keeps everything.
    """
    sample = _least_shingle(_labelled(docs, labels, id_col, text_col, rows))
    first = sample.groupBy("least").agg(F.min("doc_id").alias("doc_id"))
    sample = cut_lineage(sample.join(first, ["least", "doc_id"]).dropDuplicates(["least"]).select("text", "bad", "toxic"))
    n = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    counted = cut_lineage(_counted(sample).where("n >= 3"))
    model = {k: _strongest(counted, k, n["n"], n[k]) for k in ("bad", "toxic")}
    got = _features(sample, model["bad"], model["toxic"]).toArrow()  # a dozen numbers for each row of the sample
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(SHAPE) + 2)
    weights = {k: fit(expand(x), np.array(got.column(k).to_pylist(), float)) for k in ("bad", "toxic")}
    if not n["n"]:
        weights = {k: np.r_[np.zeros(2 * len(SHAPE) + 2), -10.0] for k in weights}
    return {"signs": model, "weights": weights}


def score_documents(docs: DataFrame, model: dict, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """rid, doc_id, host, path, p_bad and p_toxic from the text alone."""
    bad, toxic = model["signs"]["bad"], model["signs"]["toxic"]
    w = np.stack([model["weights"]["bad"], model["weights"]["toxic"]], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Evidence(bad), Evidence(toxic)
        for batch in batches:
            x = [described(text, *signs) for text in texts(batch.column(4))]
            p = 1 / (1 + np.exp(-np.clip(expand(np.array(x, float).reshape(-1, len(SHAPE) + 2)) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(p[:, 0]), pa.array(p[:, 1])], ["rid", "doc_id", "host", "path", "p_bad", "p_toxic"])

    return docs.select(
        F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.coalesce(F.col(host_col).cast("string"), F.lit("")),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")), F.col(text_col).cast("string"),
    ).mapInArrow(run, "rid long, doc_id long, host string, path string, p_bad double, p_toxic double")


def _strength(n: str, s: str, mean: F.Column) -> F.Column:
    """Rows that the prior counts for, by the method of moments: the less groups differ beyond chance, the more."""
    n, s = F.col(n).cast("double"), F.col(s)
    within = mean * (1 - mean)
    between = F.sum((s / n - mean) ** 2 * n - within) / F.sum(n)
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.sum(n * within) / F.sum(n) / F.greatest(between, F.lit(1e-9)) - 1))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, global_p, host_p and path_p: shares of good documents, each shrunk toward the level above; and the sums they are made of.

    ``scored`` has host, path and good: a label, or the classifier's probability.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("h_n"), F.sum("s").alias("h_s"))
    whole = hosts.agg((F.sum("h_s") / F.sum("h_n")).alias("global_p"))
    prior = hosts.join(F.broadcast(whole)).agg(F.max("global_p").alias("global_p"), _strength("h_n", "h_s", F.col("global_p")).alias("k_host"))  # one row
    shrunk = hosts.join(F.broadcast(prior)).withColumn("host_p", (F.col("h_s") + F.col("k_host") * F.col("global_p")) / (F.col("h_n") + F.col("k_host")))
    joined = paths.join(shrunk, "host")
    path_prior = joined.agg(_strength("n", "s", F.col("host_p")).alias("k_path"))  # one row
    return joined.join(F.broadcast(path_prior)).withColumn("path_p", (F.col("s") + F.col("k_path") * F.col("host_p")) / (F.col("n") + F.col("k_path")))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", rows: int = LABELLED_ROWS
) -> DataFrame:
    """rid, doc_id, p_document, host_p, path_p, score and kept for every row of ``docs``.

    The classifier gives each document a probability of being good (neither of bad
    quality nor toxic) from its whole text. Labels where there are any, these probabilities elsewhere, summed up
    by path and host, give posterior means, shrunk toward the host's and the global mean as if that many
    more documents had been seen as the spread between groups says. A document's
    odds are then moved by the odds of its path's other documents over the global ones; kept are scores
    of a half and more. Null hosts and paths are one group of
    their own; null texts count as empty; repeated rows are all judged; a document labelled more than once
    counts as bad if one label says so. No rows give no rows. Other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, rows)
    scored = score_documents(docs, model, id_col, text_col, host_col, path_col)
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    named = cut_lineage(named.groupBy("doc_id").agg((1.0 - F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("double"))).alias("label")))
    inside = lambda p: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    p = inside((1 - F.col("p_bad")) * (1 - F.col("p_toxic")))
    scored = cut_lineage(scored.join(few(named), "doc_id", "left").withColumn("p_document", p).withColumn("good", F.coalesce("label", "p_document")))
    sites = cut_lineage(site_posteriors(scored))
    logit = lambda p: F.log(p / (1 - p))
    joined = scored.join(few(sites, F.length("host") + F.length("path")), ["host", "path"])
    # the document itself says nothing of its site
    host = (F.col("h_s") - F.col("good") + F.col("k_host") * F.col("global_p")) / (F.col("h_n") - 1 + F.col("k_host"))
    path = (F.col("s") - F.col("good") + F.col("k_path") * host) / (F.col("n") - 1 + F.col("k_path"))
    score = 1 / (1 + F.exp(-(logit(F.col("p_document")) + logit(inside(path)) - logit(inside(F.col("global_p"))))))
    return joined.select("rid", "doc_id", "host", "path", "p_document", "host_p", "path_p", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)


def drop_rejected(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns. ``docs`` has to be a stored table."""
    return without(docs, classify(docs, labels, **names).where(~F.col("kept")))
