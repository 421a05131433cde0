"""Operator 4: a convolutional text classifier, trained in numpy, scored inside the scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import drop, keep, slices

STRIP = ".,;:!?\"'()[]{}<>|*_-"
PAD = 3  # zero vectors after each text, so that no window spans two texts
FEATURES = 5  # of a word, at most
WORDS_HELD = 120_000  # words that are told apart at a time; a word met again after them is looked up anew, with the same features


@dataclass(frozen=True)
class Settings:
    """Training takes at most ``positives`` + ``negatives`` labelled texts of up to ``longest`` characters."""

    positives: int = 2500
    negatives: int = 5000
    longest: int = 60_000
    buckets: int = 1 << 16
    size: int = 12
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 7
    steps: int = 1300  # at least: a small sample is gone over more often
    rate: float = 0.02
    seed: int = 11


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def buckets_of(word: str, buckets: int) -> list[int]:
    """Hashed features of a word: itself and its beginnings of three to six letters."""
    w = word.strip(STRIP)
    parts = ["=" + w, *(f"^{w[:n]}" for n in range(3, 7) if len(w) >= n)]
    return [xxhash.xxh3_64_intdigest(p) % buckets for p in parts]


class Lexicon:
    """Rows of a growing matrix for the words met, bounded: past ``limit`` words it starts over between texts."""

    def __init__(self, table: np.ndarray, limit: int = WORDS_HELD):
        self.table, self.limit = table, limit
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.rows = np.zeros((1024, self.table.shape[1]), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        index = self.index
        try:
            return np.fromiter(map(index.__getitem__, words), np.int32, len(words))
        except KeyError:
            pass
        for w in words:
            if w not in index:
                at = index[w] = len(index)
                if at >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[at] = self.table[buckets_of(w, len(self.table))].sum(0)
        return np.fromiter(map(index.__getitem__, words), np.int32, len(words))


@dataclass
class Model:
    settings: Settings
    table: np.ndarray  # buckets x size
    kernels: list[np.ndarray]  # for each width: width x size x filters
    bias: np.ndarray  # of all filters
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)


def convolve(model: Model, x: np.ndarray) -> list[np.ndarray]:
    """For each width, the filters' values at every position of ``x`` where the window fits."""
    found = []
    for k in model.kernels:
        n = len(x) - len(k) + 1
        y = x[:n] @ k[0]
        for j in range(1, len(k)):
            y += x[j : n + j] @ k[j]
        found.append(y)
    return found


def score_texts(model: Model, lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
    """Scores in 0..1 of whole texts; long ones run in overlapping slices, whose maxima are the text's."""
    step, tail = 50_000, [0] * PAD
    parts, owner = [], []
    for i, text in enumerate(texts):
        ids = lexicon.ids(words_of(text))
        for at in range(0, max(1, len(ids)), step):
            parts.append(np.concatenate([ids[at : at + step + len(model.kernels)], tail]).astype(np.int32))
            owner.append(i)
    top = np.full((len(texts), len(model.bias)), -np.inf, np.float32)
    first = 0
    while first < len(parts):
        last, total = first, 0
        while last < len(parts) and (last == first or total + len(parts[last]) <= 2 * step):
            total += len(parts[last])
            last += 1
        starts = np.cumsum([0, *(len(p) for p in parts[first : last - 1])])
        x = lexicon.rows[np.concatenate(parts[first:last])]
        peaks = np.concatenate([np.maximum.reduceat(y, starts, axis=0) for y in convolve(model, x)], axis=1)
        np.maximum.at(top, owner[first:last], peaks)
        first = last
    hidden = np.maximum(top + model.bias, 0)
    z = np.clip(hidden @ model.out + model.shift, -30, 30)
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def encoded(texts: list[str], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the rows of its words in a grid of features, and that grid, in which ``buckets`` stands for none.

    Only ``WORDS_HELD`` words are Python objects at a time, so memory is that of the numbers.
    """
    grid, n = np.full((1024, FEATURES), buckets, np.int32), 1  # row 0 has no features
    known: dict[str, int] = {"": 0}
    docs = []
    for t in texts:
        ids = []
        for w in words_of(t):
            at = known.get(w)
            if at is None:
                if len(known) >= WORDS_HELD:
                    known = {"": 0}
                if n == len(grid):
                    grid = np.concatenate([grid, np.full_like(grid, buckets)])
                x = buckets_of(w, buckets)
                grid[n, : len(x)] = x
                at = known[w] = n
                n += 1
            ids.append(at)
        docs.append(np.asarray([*ids, *[0] * PAD], np.int32))
    return docs, grid[:n]


def train(texts: list[str], labels: np.ndarray, settings: Settings) -> Model:
    """Adam on the logistic loss; through max pooling the gradient reaches one window of each filter and text."""
    rng = np.random.default_rng(settings.seed)
    d, f, n_f = settings.size, settings.filters, settings.filters * len(settings.widths)
    model = Model(
        settings, rng.normal(0, 0.1, (settings.buckets, d)).astype(np.float32),
        [rng.normal(0, 0.3, (w, d, f)).astype(np.float32) for w in settings.widths],
        np.zeros(n_f, np.float32), rng.normal(0, 0.3, n_f).astype(np.float32), -1.0,
    )
    docs, grid = encoded(texts, settings.buckets)
    #: The last row of the table stays zero and stands for "no further feature".
    table = np.concatenate([model.table, np.zeros((1, d), np.float32)])
    moments = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, t: int) -> None:
        m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= settings.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)

    adagrad = np.full(len(table), 1e-3, np.float32)
    shift, t = np.float32(model.shift), 0
    batch, order = 48, np.arange(len(docs))
    for _ in range(max(settings.epochs, -(-settings.steps * batch // max(1, len(docs))))):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            t += 1
            starts = np.cumsum([0, *(len(docs[i]) for i in pick[:-1])])
            ids = np.concatenate([docs[i] for i in pick])
            words, where = np.unique(ids, return_inverse=True)
            x = table[grid[words]].sum(1)[where]
            maps = convolve(model, x)
            tops, args = [], []
            ends = [*starts[1:], len(ids)]
            for y in maps:
                arg = np.stack([s + y[s : min(e, len(y))].argmax(0) for s, e in zip(starts, ends, strict=True)])
                args.append(arg)
                tops.append(np.take_along_axis(y, arg, 0))
            pre = np.concatenate(tops, 1) + model.bias
            hidden = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + shift, -30, 30)))
            g = ((p - labels[pick]) / len(pick)).astype(np.float32)
            g_pre = np.outer(g, model.out).astype(np.float32) * (pre > 0)
            g_table_rows, g_table_vals = [], []
            for w_at, k in enumerate(model.kernels):
                gk = np.zeros_like(k)
                part = g_pre[:, w_at * f : (w_at + 1) * f]
                arg = args[w_at]
                for j in range(len(k)):
                    xi = x[arg + j]  # batch x filters x size
                    gk[j] = np.einsum("bf,bfd->df", part, xi)
                    live = part != 0
                    g_table_rows.append(ids[(arg + j)[live]])
                    g_table_vals.append(part[live][:, None] * k[j].T[np.nonzero(live)[1]])
                adam(f"k{w_at}", k, gk, t)
            adam("b", model.bias, g_pre.sum(0), t)
            adam("o", model.out, hidden.T @ g, t)
            shift -= np.float32(settings.rate * g.sum())
            rows = np.concatenate(g_table_rows)
            if len(rows):
                feats = grid[rows]  # n x FEATURES
                vals = np.repeat(np.concatenate(g_table_vals), FEATURES, axis=0)
                flat = feats.ravel()
                keep = flat != settings.buckets
                uniq, back = np.unique(flat[keep], return_inverse=True)
                total = np.zeros((len(uniq), d), np.float32)
                np.add.at(total, back, vals[keep])
                adagrad[uniq] += (total**2).mean(1)
                table[uniq] -= 0.05 * total / np.sqrt(adagrad[uniq])[:, None]
    model.table, model.shift = table[:-1], float(shift)
    return model


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str], default: float = 0.3, least: int = 15) -> dict[str, float]:
    """For each language the middle of the thresholds between 0.05 and 0.95 that give the best F1."""
    out = {}
    langs = np.asarray([x or "" for x in langs])
    grid = np.round(np.arange(0.05, 0.951, 0.05), 2)
    for lang in np.unique(langs):
        s, y = scores[langs == lang], labels[langs == lang] > 0
        if y.sum() < least:
            continue
        f1 = np.array([2 * (y & (s >= g)).sum() / max(1, y.sum() + (s >= g).sum()) for g in grid])
        out[str(lang)] = float(np.median(grid[f1 >= f1.max() - 1e-9]))
    return out


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on a bounded sample of the labelled rows whose ``crc32(id) % 4`` isn't 2.

    The sample is the rows with the smallest hash of their id, up to ``positives`` and ``negatives``; its ids are
    few enough to broadcast, so only its own texts are shuffled.  Rows that share an id give one text, the least.  A fifth of it is held back to calibrate the thresholds on a first model;
    the model that scores is trained on all of it.
    """
    usable = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1))
        .where("pmod(crc32(cast(%s as string)), 4) <> 2" % id_col)
        .groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_y"))
    )
    picked = None
    for y, n in ((1, settings.positives), (0, settings.negatives)):
        part = usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
        picked = part if picked is None else picked.union(part)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit("")
    sample = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang"))
        .where(F.length("_text") <= settings.longest)
        .join(F.broadcast(picked), "_id")
        # an id that repeats gives one text, however often it does
        .groupBy("_id", "_y").agg(F.min(F.struct("_text", "_lang")).alias("_t"))
        .select("_id", "_y", "_t._lang", "_t._text").toArrow()
    )
    order = np.argsort([xxhash.xxh3_64_intdigest(f"{i}") for i in sample.column("_id").to_pylist()], kind="stable")
    texts, langs = sample.column("_text").to_pylist(), sample.column("_lang").to_pylist()
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    y = np.asarray(sample.column("_y").to_pylist(), np.float32)[order]
    del sample
    back = len(texts) // 5
    if not len(texts) or y[back:].min() == y[back:].max():
        d, n_f = settings.size, settings.filters * len(settings.widths)  # nothing to learn: every score is the base rate
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Model(settings, np.zeros((settings.buckets, d), np.float32), [np.zeros((w, d, settings.filters), np.float32) for w in settings.widths], np.zeros(n_f, np.float32), np.zeros(n_f, np.float32), float(np.log(rate / (1 - rate))))
    first = train(texts[back:], y[back:], settings)
    thresholds = calibrate(score_texts(first, Lexicon(first.table), texts[:back]), y[:back], langs[:back])
    del first
    drop()
    model = train(texts, y, settings)  # the fifth held back for the thresholds counts too: languages have few examples
    model.thresholds = thresholds
    del texts
    drop()  # the driver goes on without what training took
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (double, 0..1) added; one pass over whole texts, no shuffle.

    Null and empty texts get the score of no words; a column named ``toxicity`` is replaced.  Repeated rows keep
    their own rows; an empty table stays empty; other columns pass through unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x size floats
    number = shared._jbroadcast.id()
    names = [c for c in docs.columns if c != "toxicity"]
    schema = docs.select(*names).withColumn("toxicity", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = keep(("toxicity", number), lambda: Lexicon(m.table))
        for batch in (x for b in batches for x in slices(b)):
            texts = batch.column(names.index(text_col)).to_pylist()
            found = [np.zeros(0)]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1_000_000):
                    size += len(texts[end] or "")
                    end += 1
                found.append(score_texts(m, lexicon, texts[at:end]))
                if len(lexicon.index) > lexicon.limit:
                    lexicon.reset()
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found), pa.float64())], [*names, "toxicity"])

    return docs.select(*names).mapInArrow(run, schema)


def threshold_column(model: Model, lang, default: float = 0.3):
    """The calibrated threshold of a row's language; ``default`` for languages that had too few examples."""
    if not model.thresholds:
        return F.lit(default)
    table = F.create_map(*[x for k, v in sorted(model.thresholds.items()) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.coalesce(lang, F.lit(""))), F.lit(default))
