"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilworks.llm.engine import settle, table
from veilworks.llm.learning import labelled_sample, remainder
from veilworks.llm.quality import LETTER
from veilworks.llm.textbytes import LOWER, SPACE, flat, owners, slices, span_hashes, spans

#: Words by which a text addresses its reader, in English, French, German and Spanish.
SECOND_PERSON = "you your yours yourself youre ya u tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer tú ti tus usted ustedes vosotros vuestro".split()
#: A small fixed list of common insults in the same languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers trash garbage scum clown pathetic worthless disgusting fool foolish imbecile jerk creep coward liar "
    "pig filthy ugly vermin ignorant useless lunatic bastard bitch asshole shit crap idiote idiots imbécile crétin stupide ordure connard salaud abruti minable "
    "dumm dummkopf trottel arschloch abschaum blöd depp vollidiot widerlich estúpido estúpida imbécil basura escoria idiota inútil asqueroso payaso patético"
).split()
STEMS = (5, 6, 7, 8, 9)
#: A word this many times likelier in toxic texts of the lexicon part is listed.
LIST_AT = 4.0

FEATURES = [
    "words", "insults_per_word", "insults", "listed_per_word", "listed_weight_per_word", "listed_count", "strongest_word", "second_strongest",
    *[f"stem{k}_per_word" for k in STEMS], *[f"stem{k}_strongest" for k in STEMS],
    "second_person_per_word", "listed_near_second_person", "capitals", "loud_words", "exclaims", "questions", "punctuation",
    "digit_in_word", "symbol_in_word", "stretched_letters", "single_letters",
]


@dataclass
class Lexicon:
    """Log odds of toxic against other texts, by hash of a word or of a word's first bytes."""

    words: tuple[np.ndarray, np.ndarray]
    stems: dict[int, tuple[np.ndarray, np.ndarray]]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented capitals of Latin-1 in UTF-8."""
    out = LOWER[data]
    if len(out) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        out[1:][latin] += 0x20
    return out


def word_table(data: np.ndarray, offsets: np.ndarray):
    """Letter runs of folded text: their hashes, the hashes of their first bytes, and whose they are."""
    low = fold(data)
    starts, ends, at = spans(low, offsets, LETTER)
    stems = {}
    for k in STEMS:
        long = np.flatnonzero(ends - starts >= k)
        stems[k] = (long, span_hashes(low, starts[long], starts[long] + k))
    return span_hashes(low, starts, ends), stems, owners(at), starts, ends, at


def look_up(known: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """The weight of each hash, 0 for unknown ones."""
    keys, weights = known
    if not len(keys) or not len(h):
        return np.zeros(len(h))
    maybe = np.zeros(1 << 16, bool)
    maybe[keys >> np.uint64(48)] = True
    out = np.zeros(len(h))
    some = np.flatnonzero(maybe[h >> np.uint64(48)])
    i = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
    hit = keys[i] == h[some]
    out[some[hit]] = weights[i[hit]]
    return out


@lru_cache
def fixed(words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A word list in the form of look_up()."""
    data, offsets = flat(pa.array(words))
    h = np.unique(span_hashes(data, *spans(data, offsets)[:2]))
    return h, np.ones(len(h))


def per_text(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, values, n)


def strongest(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, of, values)
    return out


def features(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n, size = len(offsets) - 1, np.maximum(1, np.diff(offsets))
    h, stems, of, starts, ends, at = word_table(data, offsets)
    words = np.diff(at)
    each = np.maximum(1, words)
    weight = look_up(lexicon.words, h)
    insult = look_up(fixed(tuple(INSULTS)), h)
    hot = np.flatnonzero((weight > 0) | (insult > 0))
    insults = per_text(insult[hot], of[hot], n)
    cols = [np.log1p(words), insults / each * 1e3, insults, per_text(weight[hot] > 0, of[hot], n) / each * 1e3, per_text(weight[hot], of[hot], n) / each * 1e3, per_text(weight[hot] > 0, of[hot], n)]
    top = strongest(weight[hot], of[hot], n)
    rest = hot[weight[hot] < top[of[hot]]]
    cols += [top, strongest(weight[rest], of[rest], n)]
    dense, peak = [], []
    for k in STEMS:
        index, hashes = stems[k]
        w = look_up(lexicon.stems.get(k, (np.zeros(0, np.uint64), np.zeros(0))), hashes)
        some = np.flatnonzero(w > 0)
        dense.append(per_text(w[some], of[index[some]], n) / each * 1e3)
        peak.append(strongest(w[some], of[index[some]], n))
    cols += dense + peak
    you = np.flatnonzero(look_up(fixed(tuple(SECOND_PERSON)), h))
    near = np.zeros(n)
    if len(you) and len(hot):
        i = np.searchsorted(you, hot)
        gap = np.full(len(hot), 1 << 30)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(you) - 1)):
            gap = np.minimum(gap, np.where(of[you[j]] == of[hot], np.abs(you[j] - hot), 1 << 30))
        near = per_text(gap <= 5, of[hot], n)
    cols += [per_text(np.ones(len(you)), of[you], n) / each * 1e3, near]

    def rate(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    capital = (data >= 65) & (data <= 90)
    sums = np.concatenate([[0], np.cumsum(capital)])
    loud = (ends - starts >= 3) & (sums[ends] - sums[starts] == ends - starts) if len(starts) else np.zeros(0, bool)
    cols += [rate(capital), per_text(loud, of, n) / each, rate(data == 33), rate(data == 63), rate(~LETTER[data] & ~SPACE[data])]
    digit, letter = (data >= 48) & (data <= 57), LETTER[data]
    symbol = ~letter & ~SPACE[data]
    alpha = letter & ~digit
    inner = np.zeros(len(data), bool)
    inner[1:-1] = digit[1:-1] & alpha[:-2] & alpha[2:]
    masked = np.zeros(len(data), bool)
    masked[1:-1] = symbol[1:-1] & alpha[:-2] & alpha[2:]
    stretched = np.zeros(len(data), bool)
    stretched[2:] = alpha[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    single = ends - starts == 1
    cols += [rate(inner) * 1e3, rate(masked) * 1e3, rate(stretched) * 1e3, per_text(single, of, n) / each]
    return np.stack(cols, 1).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


def learn_lexicon(sample: DataFrame, keep: int = 4096) -> Lexicon:
    """What is likelier in toxic texts of sample (text, label): words, and words by their first bytes.

    Texts that hold a word are counted where they lie; the driver gets at most `keep` words of each kind."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 19):
            label = b.column("label").to_numpy()
            h, stems, of, *_ = word_table(*flat(b.column("text")))
            for kind, (who, hashes) in {0: (of, h), **{k: (of[i], x) for k, (i, x) in stems.items()}}.items():
                order = np.lexsort((hashes, who))
                who, hashes = who[order], hashes[order]
                new = np.ones(len(who), bool)
                new[1:] = (who[1:] != who[:-1]) | (hashes[1:] != hashes[:-1])
                who, hashes = who[new], hashes[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), kind, np.int32)), pa.array(hashes.view(np.int64)), pa.array(label[who].astype(np.int32))], ["kind", "word", "label"])

    size = sample.agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")).first()
    ones, zeros = max(1, size["a"] or 0), max(1, size["n"] - (size["a"] or 0))
    found = sample.select("text", "label").mapInArrow(reduce, "kind int, word long, label int").groupBy("kind", "word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    weight = F.log((F.col("a") + 0.25) / (ones + 0.5) / ((F.col("b") + 0.25) / (zeros + 0.5)))
    good = found.withColumn("weight", weight).filter((F.col("a") >= 2) & (F.col("weight") >= float(np.log(LIST_AT))))
    best = Window.partitionBy("kind").orderBy(F.desc(F.col("a") * F.col("weight")), "word")
    rows = good.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep).select("kind", "word", "weight").collect()

    def listed(kind: int) -> tuple[np.ndarray, np.ndarray]:
        mine = sorted((r["word"] & ((1 << 64) - 1), r["weight"]) for r in rows if r["kind"] == kind)
        return np.array([w for w, _ in mine], np.uint64), np.array([x for _, x in mine], float)

    return Lexicon(listed(0), {k: listed(k) for k in STEMS})


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0) -> tuple[list, float]:
    """Histogram gradient boosting for the logistic loss. A tree: split feature, split value, value by heap index."""
    if not len(y):
        return [], 0.0
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    f, trees = np.full(len(y), base), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p) + 1e-9
        feature, split, value = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.float32), np.zeros((1 << depth + 1) - 1)
        node = np.zeros(len(y), np.int64)
        for k in range((1 << depth + 1) - 1):
            rows = np.flatnonzero(node == k)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value[k] = -total_g / (total_h + 1.0) * rate
            if k >= len(feature) or len(rows) < 4:
                continue
            best = (1e-6, None, None)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(cuts[j]) + 1))[:-1]
                nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(cuts[j]) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], j, i)
            if best[1] is not None:
                feature[k], split[k] = best[1], cuts[best[1]][best[2]]
                node[rows] = np.where(binned[rows, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
        f += value[node]
        trees.append((feature, split, value.astype(np.float32)))
    return trees, base


def raw_score(model: ToxicityModel, x: np.ndarray) -> np.ndarray:
    f, rows = np.full(len(x), model.base), np.arange(len(x))
    for feature, split, value in model.trees:
        node = np.zeros(len(x), np.int64)
        while (inner := node < len(feature)).any():
            k = np.where(inner, node, 0)
            j = feature[k]
            moves = inner & (j >= 0)
            if not moves.any():
                break
            node = np.where(moves, 2 * k + 1 + (x[rows, np.maximum(j, 0)] > split[k]), node)
        f += value[node]
    return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising step function, smoothed by one observation of the mean."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + n, blocks[-1][2], hi]
    mean = y.mean()
    xs, ys = [], []
    for v, n, lo, hi in blocks:
        for s in sorted({lo, hi}):
            xs.append(s)
            ys.append((v + mean) / (n + 1))
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def train_toxicity(lexicon: Lexicon, x: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """Trees from rows that never saw their own words listed; calibration uses scores that five folds give each row."""
    if not len(y):
        return ToxicityModel(lexicon)
    if y.min() == y.max():
        return ToxicityModel(lexicon, [], 0.0, (np.array([0.0]), np.array([(y.sum() + 1) / (len(y) + 2)])))
    fold_of, held = np.arange(len(y)) % 5, np.zeros(len(y))
    for k in range(5):
        trees, base = boost(x[fold_of != k], y[fold_of != k])
        held[fold_of == k] = raw_score(ToxicityModel(lexicon, trees, base), x[fold_of == k])
    trees, base = boost(x, y)
    return ToxicityModel(lexicon, trees, base, isotonic(held, y))


def collect_features(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample's texts, a row of len(FEATURES) numbers each, in order of a hash of the id."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 19):
            x = features(lexicon, *flat(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    got = sample.select("doc_id", "text", "label").mapInArrow(reduce, "doc_id long, label int, x binary").select("label", "x").orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").collect()
    return np.stack([np.frombuffer(r["x"], np.float32) for r in got]) if got else np.zeros((0, len(FEATURES)), np.float32), np.array([r["label"] for r in got], float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 2500, modulus: int = 4, held_out: int = 2) -> ToxicityModel:
    """A model from at most `bound` labelled rows of each class, whole texts; held-out rows never enter.

    Half of the rows, by a hash of the id, give the lexicon, the trees learn from the others. Texts are
    reduced to counts and features where they lie; the driver gets words of the lexicon and features."""
    sample = settle(labelled_sample(docs, labels, "toxic", modulus, held_out, bound))
    half = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(2))
    lexicon = learn_lexicon(sample.filter(half == 0))
    return train_toxicity(lexicon, *collect_features(sample.filter(half == 1), lexicon))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs, from its whole text alone.

    A null or empty text has all features 0 and is scored like any other. Without labelled rows every
    score is 0.5. Rows with equal texts score alike; other columns are ignored; an empty table gives
    an empty result. The model is of bounded size and travels with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 21):
            m = shared.value
            s = np.interp(raw_score(m, features(m.lexicon, *flat(b.column("text")))), *m.knots)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")
