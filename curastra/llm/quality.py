"""Quality classifier by co-training of two views.

The text view sees the words of a document, the metadata view its other columns and its
layout (length, lines, repeated lines, kinds of characters). Each is a logistic regression.
In every round each view labels the unlabelled documents it is most sure of, as many good as
bad ones in the labelled share, and hands them to the other view as training rows. At the
end both are calibrated (Platt) on held-out labelled rows and combined into one score.

The models are fitted on the driver, on a bounded number of labelled rows (``Settings``; those
with the smallest hash of the id, whatever the table's order) and on the pseudo-labelled ones.
The unlabelled documents' words (as hashes) and layouts are taken once and stored; each round
scores all of these rows in a distributed pass, and only the words and layouts of those it picks
come to the driver. Scoring runs over all documents in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, slices, small_batches, text_buffer, tidy

_WORD = re.compile(r"[^\W_]+|[^\w\s]")


@dataclass(frozen=True)
class Settings:
    """What bounds the driver's work; it doesn't grow with the tables."""

    labelled: int = 5_000  #: labelled documents used for training and calibration
    pool: int = 2_000  #: pseudo-labels in all; the documents are the surest of the whole table
    words: int = 20_000  #: words of the text view, the most frequent of the training rows
    levels: int = 50  #: values of a category column that get a feature, the most frequent; others have none
    rounds: int = 4
    per_round: int = 200  #: pseudo-labels a view gives in a round
    hold_out: float = 0.3  #: share of the labelled rows kept for calibration
    reject: float = 0.3  #: documents with a score under it are rejected


@dataclass
class Logistic:
    """Weights of a logistic regression over standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weight + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
    """Newton's method with a ridge penalty and classes weighted alike."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(z @ w)
        gradient = z.T @ (share * (p - y)) + penalty * w
        curve = (z * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


LAYOUT = ["log_length", "lines", "line_length", "repeated_lines", "letters", "upper", "digits", "other", "word_length", "distinct_words", "repeated_words", "ends_open"]


def layout(text: str, words: Counter, total: int) -> list[float]:
    """Numbers that tell how a text is laid out, not what it says."""
    n = max(len(text), 1)
    lines = [x for x in text.split("\n") if x]
    letters = sum(c for w, c in words.items() if w[0].isalnum()) or 1
    symbols = total - letters if total else 0
    upper = sum(len(w) * c for w, c in words.items() if w.isupper() and len(w) > 1)
    digits = sum(len(w) * c for w, c in words.items() if w.isdigit())
    size = sum(len(w) * c for w, c in words.items() if w[0].isalnum())
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(lines))),
        float(np.log1p(n / max(len(lines), 1))),
        1 - len(set(lines)) / max(len(lines), 1),
        size / n,
        upper / n,
        digits / n,
        symbols / max(total, 1),
        size / letters,
        len(words) / max(total, 1),
        max(words.values(), default=0) / max(total, 1),
        0.0 if text.rstrip().endswith((".", "!", "?")) else 1.0,
    ]


def _cut_words(text: str) -> tuple[Counter, int]:
    found = _WORD.findall(text)
    return Counter(found), len(found)


def hashed(bag: Counter) -> np.ndarray:
    """Two rows: the hash of each word, and its count."""
    out = np.empty((2, len(bag)), dtype=np.uint32)
    out[0] = [zlib.crc32(w.encode()) for w in bag]
    out[1] = list(bag.values())
    return out


@dataclass
class TextView:
    """Log-odds of words, and sums of them as features of a logistic regression."""

    word: np.ndarray  #: hashes, sorted
    odds: np.ndarray

    @staticmethod
    def learn(bags: list[np.ndarray], y: np.ndarray, size: int) -> TextView:
        word, at = np.unique(np.concatenate([b[0] for b in bags] or [np.zeros(0, np.uint32)]), return_inverse=True)
        label = np.repeat(np.asarray(y) > 0, [b.shape[1] for b in bags])
        good, bad = (np.bincount(at[own], minlength=len(word)) for own in (label, ~label))
        n_good, n_bad = max(int((y > 0).sum()), 1), max(int((y <= 0).sum()), 1)
        order = np.lexsort((word, -(good + bad)))[:size]
        kept = np.sort(order[(good + bad)[order] > 2])
        return TextView(word[kept], np.log((good[kept] + 1) / (n_good + 2)) - np.log((bad[kept] + 1) / (n_bad + 2)))

    def features(self, bags: list[np.ndarray], totals) -> np.ndarray:
        """A row for each bag: mean odds of its different words and of all words, least and largest, share of known words."""
        size = np.array([b.shape[1] for b in bags], dtype=np.int64)
        out = np.zeros((len(bags), 5))
        if not len(self.word) or not size.sum():
            return out
        flat, count = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
        at = np.minimum(np.searchsorted(self.word, flat), len(self.word) - 1)
        known = self.word[at] == flat
        row, v, c = np.repeat(np.arange(len(bags)), size)[known], self.odds[at[known]], count[known].astype(np.float64)
        if not len(row):
            return out
        some, start, n = np.unique(row, return_index=True, return_counts=True)
        total = np.maximum(np.asarray(totals, dtype=np.float64), 1)[some]
        sums = [np.bincount(row, x, minlength=len(bags))[some] for x in (v, v * c, c)]
        out[some] = np.column_stack([sums[0] / n, sums[1] / total, np.minimum.reduceat(v, start), np.maximum.reduceat(v, start), sums[2] / total])
        return out


def _kinds(row: dict, levels: dict[str, list[str]]) -> list[float]:
    return [float(row.get(c) == v) for c, values in levels.items() for v in values]


def _views(text: str, row: dict, levels: dict[str, list[str]]) -> tuple[np.ndarray, int, list[float]]:
    """(hashed words, their number, features of the metadata)."""
    bag, total = _cut_words(text)
    return hashed(bag), total, layout(text, bag, total) + _kinds(row, levels)


@dataclass
class Model:
    """Both views and their calibrated combination."""

    text_view: TextView
    text: Logistic
    meta: Logistic
    levels: dict[str, list[str]]  #: values of each categorical column that got a feature
    combine: Logistic
    settings: Settings

    def score(self, texts: list[str], rows: list[dict]) -> np.ndarray:
        """(text score, metadata score, combined score) of each document, 0 to 1."""
        if not texts:
            return np.zeros((0, 3))
        bags, totals, meta = zip(*(_views(x, r, self.levels) for x, r in zip(texts, rows, strict=True)), strict=True)
        margin = np.stack([self.text.margin(self.text_view.features(list(bags), totals)), self.meta.margin(np.array(meta))], axis=1)
        return np.column_stack([_sigmoid(margin), _sigmoid(self.combine.margin(margin))])


#: From (text view, its regression, the metadata's one, picks a view makes of each label): the picked rows by the
#: view that takes them over, with ``bag``, ``total``, ``meta`` and ``y``.
Propose = Callable[[TextView, Logistic, Logistic, dict[float, int]], dict[str, list[tuple]]]


def co_train(labelled: list[tuple], levels: dict[str, list[str]], settings: Settings, propose: Propose) -> Model:
    """Train on rows (bag, total, meta, y) with y in 0, 1, and on what ``propose`` finds."""
    rows = list(labelled)
    n, y = len(rows), np.array([r[3] for r in rows])
    held = np.arange(n) % 10 < round(10 * settings.hold_out)  # the rows come ordered by a hash
    given = {view: {i: y[i] for i in np.flatnonzero(~held).tolist()} for view in ("text", "meta")}
    good = max(1, round(settings.per_round * (float(y.mean()) if n else 0.5)))
    most = {1.0: good, 0.0: max(1, settings.per_round - good)}

    def features(view: TextView, own: list[int]) -> np.ndarray:
        return view.features([rows[i][0] for i in own], [rows[i][1] for i in own])

    for turn in range(settings.rounds + 1):
        own = list(given["text"])
        values = np.array([given["text"][i] for i in own])
        # a word's odds must not come from the row they are used on: learn from one half, fit on the other
        half = np.arange(len(own)) % 2 == 0
        learn = TextView.learn([rows[own[k]][0] for k in np.flatnonzero(half)], values[half], settings.words)
        text = fit_logistic(features(learn, [own[k] for k in np.flatnonzero(~half)]), values[~half])
        own_m = list(given["meta"])
        meta = fit_logistic(np.array([rows[i][2] for i in own_m]), np.array([given["meta"][i] for i in own_m]))
        if turn == settings.rounds:
            break
        for to, found in propose(learn, text, meta, most).items():
            given[to].update({len(rows) + k: r[3] for k, r in enumerate(found)})
            rows += found
    last = np.flatnonzero(held).tolist()
    margin = np.stack([text.margin(features(learn, last)), meta.margin(np.array([rows[i][2] for i in last]))], axis=1)
    combine = fit_logistic(margin, y[held]) if len(set(y[held])) > 1 else Logistic(np.zeros(2), np.ones(2), np.ones(2), 0.0)
    return Model(learn, text, meta, levels, combine, settings)


def _given(batch: pa.RecordBatch, columns) -> list[dict]:
    values = [batch.column(c).to_pylist() for c in columns]
    return [dict(zip(columns, v, strict=True)) for v in zip(*values, strict=True)] if columns else [{}] * batch.num_rows


def _bags(column: pa.Array) -> list[np.ndarray]:
    raw, start, size = text_buffer(column)
    return [np.frombuffer(raw[a : a + n].tobytes(), dtype=np.uint32).reshape(2, -1) for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def _view_pass(rows: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """(id, h, bag, total, meta) of every row: what both views see of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bag, total, meta = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), _given(batch, list(levels)), strict=True):
                b, t, m = _views(text, own, levels)
                bag.append(b.tobytes()), total.append(t), meta.append(m)
            cols = [batch.column("id"), batch.column("h"), pa.array(bag, pa.binary()), pa.array(total, pa.int64()), pa.array(meta, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "bag", "total", "meta"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, h long, bag binary, total long, meta array<double>")


def _margins(seen: DataFrame, view: TextView, text: Logistic, meta: Logistic) -> DataFrame:
    """(id, h, text, meta): how sure each view is of every row; alike however rows are batched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="bag"):
            own = view.features(_bags(batch.column("bag")), batch.column("total").to_numpy())
            layouts = batch.column("meta").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(meta.mean))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(np.round(text.margin(own), 9)), pa.array(np.round(meta.margin(layouts), 9))], names=["id", "h", "text", "meta"])

    return seen.mapInArrow(tidy(run), f"id {seen.schema['id'].dataType.simpleString()}, h long, text double, meta double")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", categories: tuple[str, ...] = ("lang", "source")) -> Model | None:
    """Co-train on the documents that ``labels`` covers; None if it has no usable label.

    Null labels and ids are left out; of several labels for an id the largest counts. All
    other documents with an id can get pseudo-labels. Of repeated ids one row is trained on:
    the smallest by words and metadata. Texts of any length are seen whole.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _trained(docs, labels, settings, id_col, text_col, label_col, categories)


def _trained(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str, categories: tuple[str, ...]) -> Model | None:
    columns = [c for c in categories if c in docs.columns]
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col]).alias("h"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *(docs[c].cast("string").alias(c) for c in columns)).where("id is not null")
    counted = {c: rows.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(settings.levels) for c in columns}
    levels = {c: [r[0] for r in n.collect()] for c, n in counted.items()}
    seen = materialize(_view_pass(rows, levels), "views")

    def bagged(ids: DataFrame) -> list[tuple]:
        # (id, bag, total, meta, y) of a bounded number of ids, in order of their hashes
        found = sorted(seen.join(F.broadcast(ids.select("id", "y")), "id").toArrow().to_pylist(), key=lambda r: (r["h"], r["id"], r["bag"], r["meta"]))
        one = {(r["id"], r["y"]): r for r in reversed(found)}
        return [(i, np.frombuffer(r["bag"], dtype=np.uint32).reshape(2, -1), r["total"], r["meta"], y) for (i, y), r in reversed(one.items())]

    # a bounded sample: the smallest hashes
    sample = seen.select("id", "h").distinct().join(known, "id").orderBy("h", "id").limit(settings.labelled)
    labelled = bagged(materialize(sample.select("id", (F.col("y") > 0).cast("double").alias("y")), "labelled"))
    if len({r[4] for r in labelled}) < 2:
        return None
    known_ids = materialize(known.select("id"), "known")
    taken: list = []

    def propose(view: TextView, text: Logistic, meta: Logistic, most: dict[float, int]) -> dict[str, list[tuple]]:
        margins = _margins(seen, view, text, meta).join(known_ids, "id", "left_anti")  # words aren't shuffled
        if taken:
            margins = margins.where(~F.col("id").isin(taken))
        ends = materialize(margins.groupBy("id", "h").agg(*(f(c).alias(f"{c}_{k}") for c in ("text", "meta") for k, f in (("up", F.max), ("down", F.min)))), "margins")
        picks = []
        for sure, to in (("text", "meta"), ("meta", "text")):
            for label, order, enough in ((1.0, F.desc(f"{sure}_up"), f"{sure}_up > 0"), (0.0, F.asc(f"{sure}_down"), f"{sure}_down < 0")):
                picks += [(r.id, label, to) for r in ends.where(enough).orderBy(order, "h", "id").limit(most[label]).collect()]
        picks = picks[: max(settings.pool - len(taken), 0)]
        if not picks:
            return {}
        kind = seen.schema["id"].dataType.simpleString()
        found = {(r[0], r[4]): r[1:] for r in bagged(docs.sparkSession.createDataFrame(sorted({p[:2] for p in picks}), f"id {kind}, y double"))}
        taken.extend(sorted({p[0] for p in picks}))
        return {to: [found[i, y] for i, y, t in picks if t == to] for to in ("meta", "text")}

    return co_train([r[1:] for r in labelled], levels, settings, propose)


def classify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds ``text_score``, ``meta_score``, ``score`` (0 to 1, higher is better) and ``accepted``.

    Every row is scored by its whole text and its metadata; a null text counts as empty. With
    no model (nothing to learn from) scores are null and all rows are accepted. Input columns
    with those names are replaced; repeated rows each get a row; no shuffle.
    """
    small_batches(docs.sparkSession)
    new = {"text_score": "double", "meta_score": "double", "score": "double", "accepted": "boolean"}
    others = [c for c in docs.columns if c not in new]
    if model is None:
        return docs.select(*(docs[c] for c in others), *(F.lit(True if c == "accepted" else None).cast(k).alias(c) for c, k in new.items()))
    categories = list(model.levels)
    rows = docs.select(F.struct(*(docs[c] for c in others)).alias("rest"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *(docs[c].cast("string").alias(c) for c in categories))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.score(batch.column("text").to_pylist(), _given(batch, categories))
            cols = [batch.column("rest"), *(pa.array(score[:, k]) for k in range(3)), pa.array(score[:, 2] >= model.settings.reject)]
            yield pa.RecordBatch.from_arrays(cols, names=["rest", *new])

    kinds = ", ".join(f"{c} {k}" for c, k in new.items())
    out = rows.mapInArrow(tidy(run), f"rest {rows.schema['rest'].dataType.simpleString()}, {kinds}")
    return out.select(*(F.col("rest")[c].alias(c) for c in others), *new)
