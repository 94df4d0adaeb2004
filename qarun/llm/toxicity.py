"""Toxicity: a classifier that may not react to which group a sentence mentions."""

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qarun.llm.common import as_text

# Our own choice: groups of terms of which any may stand for any other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "chinese", "indian", "mexican"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)

WORD = re.compile(r"[^\W\d_]+")
# Lengths of word starts that count as features: stems of words that inflect or compound.
STEMS = range(4, 8)
# A feature can be seen once, twice, or three times and more.
LEVELS = 3


def features(text: str) -> set[str]:
    """Words and stems of a text, each with the number of times it was reached (1 to 3)."""
    words = Counter(WORD.findall(text.lower()))
    stems: dict[str, int] = defaultdict(int)
    for word, n in words.items():
        for size in STEMS:
            if len(word) <= size:
                break
            stems[word[:size]] += n
    found = set()
    for kind, counts in (("w", words), ("s", stems)):
        for name, n in counts.items():
            for level in range(1, min(n, LEVELS) + 1):
                found.add(f"{kind}{level}:{name}")
    return found


def swapped(text: str, groups: Iterable[Iterable[str]] = IDENTITY_TERMS) -> str | None:
    """The text with every identity term replaced by the next of its group, or None."""
    following = {}
    for group in groups:
        terms = list(group)
        following |= dict(zip(terms, terms[1:] + terms[:1], strict=True))
    count = 0

    def swap(match: re.Match) -> str:
        nonlocal count
        other = following.get(match[0].lower())
        count += other is not None
        return match[0] if other is None else other

    other_text = WORD.sub(swap, text)
    return other_text if count else None


class Model(NamedTuple):
    """A logistic model over a set of features."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias
        for feature in features(text or ""):
            z += self.weights.get(feature, 0.0)
        return 1 / (1 + math.exp(-max(-700.0, min(z, 700.0))))


def _parts(rows: np.ndarray) -> Iterator[np.ndarray]:
    """A thousand rows at a time, as full numbers; the whole stays in its small type."""
    for at in range(0, len(rows), 1000):
        yield rows[at : at + 1000].astype(float)


def fit_logistic(
    x: np.ndarray, y: np.ndarray, differences: np.ndarray, ridge: float, penalty: float
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss, plus a ridge, plus ``penalty`` times the
    squared change of the raw score over ``differences`` (rows: counterfactual minus original).
    """
    width = x.shape[1]
    keep = np.full(width + 1, ridge)
    keep[-1] = 1e-6
    fixed = np.diag(keep)
    for d in _parts(differences):
        fixed[:-1, :-1] += 2 * penalty * (d.T @ d)
    w = np.zeros(width + 1)

    def raw(w: np.ndarray) -> np.ndarray:
        return np.concatenate([part @ w[:-1] for part in _parts(x)]) + w[-1]

    def loss(w: np.ndarray) -> float:
        z = raw(w)
        return float(np.logaddexp(0, z).sum() - y @ z + w @ fixed @ w / 2)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(raw(w), -500, 500)))
        slope, curve = fixed @ w, fixed.copy()
        for part, q, r in zip(_parts(x), _parts(p), _parts(p - y), strict=True):
            whole = np.hstack([part, np.ones((len(part), 1))])
            slope += whole.T @ r
            curve += whole.T @ (whole * (q * (1 - q))[:, None])
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if now - new < 1e-6 * max(1.0, now):
            break
        now = new
    return w[:-1], float(w[-1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of some hundred texts hold each feature, and how many of those are toxic."""
    parts = (batch.slice(at, 500) for batch in batches for at in range(0, batch.num_rows, 500))
    for batch in parts:
        n: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for text, label in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            found = features(text)
            n.update(found)
            if label:
                toxic.update(found)
        names = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([n[x] for x in names]), pa.array([toxic[x] for x in names])],
            names=["feature", "n", "toxic"],
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id: str = "doc_id",
    text: str = "text",
    max_rows: int = 12_000,
    max_features: int = 500,
    ridge: float = 0.3,
    penalty: float = 10.0,
    groups: Iterable[Iterable[str]] = IDENTITY_TERMS,
) -> Model:
    """Fit on the labelled rows of ``docs``, at most about ``max_rows``, taken by a hash of the id.

    The ``max_features`` features that differ most between toxic and other texts enter the
    model, and all identity terms that occur. Every labelled text that mentions an identity
    term is also taken with its terms swapped, and a change of the score is penalised.

    Labels other than 0 and 1 and null ids or labels are left out; repeated rows count as
    often as they occur. Without labels of both kinds the model is constant.
    """
    groups = [list(group) for group in groups]
    labels = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)
    )
    total = labels.count()
    part = min(1.0, max_rows / max(total, 1))
    chosen = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < int(part * (1 << 20))
    # At most about max_rows pairs of numbers.
    few = F.broadcast(labels.filter(chosen))
    rows = docs.select(F.col(id).alias("id"), as_text(text).alias("text")).join(few, "id")
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    rows = rows.select("text", "label").repartition(tasks)

    counts = rows.mapInArrow(_counted, "feature string, n bigint, toxic bigint")
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    sums = {row.label: row["count"] for row in rows.groupBy("label").count().collect()}
    n0, n1 = sums.get(0, 0), sums.get(1, 0)
    if not n0 or not n1:
        return Model({}, 20.0 if n1 else -20.0)
    share = F.lit(n1 / (n0 + n1))
    surprise = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    best = counts.filter("n >= 5").orderBy(F.abs(surprise).desc(), "feature").limit(max_features)
    names = [row.feature for row in best.select("feature").collect()]
    terms = {f"w1:{term}" for group in groups for term in group}
    names = sorted({*names, *terms})
    place = {name: i for i, name in enumerate(names)}

    def present(text: str) -> list[int]:
        return sorted(place[f] for f in features(text) if f in place)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = [], []
            for text in batch.column("text"):
                own.append(present(text.as_py()))
                other_text = swapped(text.as_py(), groups)
                other.append(None if other_text is None else present(other_text))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(own, kind), pa.array(other, kind)],
                names=["label", "own", "other"],
            )

    # About max_rows rows of at most max_features small numbers.
    found = rows.mapInArrow(active, "label int, own array<int>, other array<int>").toArrow()

    def matrix(column: list) -> np.ndarray:
        x = np.zeros((len(column), len(names)), np.int8)
        for i, at in enumerate(column):
            x[i, at] = 1
        return x

    own = matrix(found.column("own").to_pylist())
    other = found.column("other").to_pylist()
    has = [i for i, at in enumerate(other) if at is not None]
    differences = matrix([other[i] for i in has]) - own[has]
    y = found.column("label").to_numpy().astype(float)
    weights, bias = fit_logistic(own, y, differences, ridge, penalty)
    return Model({f: float(w) for f, w in zip(names, weights, strict=True) if w}, bias)


def toxicity(model: Model, text: str | Column = "text") -> Column:
    """The score of each whole text, 0 to 1; null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score(text)
