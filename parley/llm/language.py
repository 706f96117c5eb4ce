"""Language identification in two steps: the family first, then pairs of languages inside it.

Texts become counts of hashed character n-grams (one to three letters, words
apart), scaled to length one. A softmax model names the language family; inside
the family every pair of languages has a linear support vector machine, and the
language that wins most pairs is the answer (ties: the larger sum of margins,
then the first name).

Scores compare learned languages with each other only. Whether a text is in one
of them at all is decided by `Known`: the share of the text's trigrams that the
predicted language's sample has, against the shares of the sample's own texts
when each is left out.

The models are fitted on a bounded sample: at most `per_language` documents of
each language (fewer if there are more than 20 languages), chosen by a hash of
text and id; each counts whole and as three short cuts, so that short texts are
learned too. Features are made on the executors; only their vectors reach the
driver, at most SAMPLE_VECTORS of them.

Defined cases: a null text, or one without a letter, is `und` with score 0;
without any learned language every text is. Texts are read whole when they are
predicted. Null languages are not learned from. Rows may repeat; other columns
are not read or pass through.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.descent import minimise
from parley.llm.shared import handed_back

UNKNOWN = "und"
FEATURES = 4_096
PER_LANGUAGE = 200
SAMPLE_VECTORS = 16_000
CUTS = 3
# Letters of the short cuts of a training text.
CUT_LETTERS = (12, 40, 120)
# Trigrams of `Known` are hashed to so many slots.
SLOT_BITS = 16
# A language's own texts may fall so far below the share of its least usual ones.
SHARE_SLACK = 0.15
# Part of the least usual texts that does not count (rows with a wrong language), and spreads allowed to a short text.
UNUSUAL, SPREADS = 0.02, 4.0
# Languages by family (fixed values, ISO 639-1). Others are a family of their own.
FAMILIES = {
    "Germanic": "af da de en fy is lb nb nl nn no sv",
    "Romance": "ca es fr gl it oc pt ro",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Baltic": "lt lv",
    "Uralic": "et fi hu",
    "Turkic": "az kk tr uz",
    "Indo-Aryan": "bn gu hi mr ne pa ur",
    "Semitic": "ar he mt",
}


def family(language: str, families: dict[str, str] = FAMILIES) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in families.items() if code in codes.split()), f"only {language}")


@functools.lru_cache(1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> np.ndarray:
    """Lower-case code points of the words, one blank between; empty if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letter_table()[points]
    if not is_letter.any():
        return points[:0]
    kept = np.where(is_letter, points, 32)
    blank = kept == 32
    return kept[~(blank & np.concatenate([[False], blank[:-1]]))]


def vector(points: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, scaled to length one."""
    x = np.concatenate([[32], points, [32]]).astype(np.uint64)
    counts = np.zeros(FEATURES)
    with np.errstate(over="ignore"):
        code = np.zeros(len(x), np.uint64)
        for n in range(3):
            code = code[: len(x) - n] * np.uint64(0x100000001B3) + x[n:] + np.uint64(n)
            slots = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            counts += np.bincount(slots.astype(np.int64), minlength=FEATURES)
    return counts / np.linalg.norm(counts)


def trigrams(points: np.ndarray) -> np.ndarray:
    """Slots of the letter trigrams of the words, one per occurrence."""
    x = np.concatenate([[32], points, [32]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = (x[:-2] * np.uint64(0x100000001B3) + x[1:-1]) * np.uint64(0x100000001B3) + x[2:]
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Known:
    """Per learned language: the slots its sample has, and the share of them a text must reach."""

    seen: dict[str, np.ndarray]
    least: dict[str, float]

    def holds(self, points: np.ndarray, language: str) -> bool:
        """Whether the share is reached, up to the spread that a text of this length may have, and half of it in any case."""
        if not len(points) or language not in self.seen:
            return False
        slots, least = trigrams(points), self.least[language]
        # One unseen letter is in three trigrams.
        spread = SPREADS * np.sqrt(3.0 * least * (1.0 - least) / len(slots))
        return bool(self.seen[language][slots].mean() >= max(least - spread, least / 2))


@dataclass
class LanguageModel:
    """Linear models: families (one weight row each), and one row per pair of a family."""

    languages: list[str]
    families: list[str]
    family_weights: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        points = letters(text)
        if not len(points) or not self.languages:
            return UNKNOWN, 0.0
        x = np.append(vector(points), 1.0)
        z = self.family_weights @ x
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        names = self.members[self.families[best]]
        wins, margins, weakest = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in itertools.combinations(names, 2):
            margin = float(self.pairs[a, b] @ x)
            wins[a if margin > 0 else b] += 1
            for name, m in ((a, margin), (b, -margin)):
                margins[name] += m
                weakest[name] = min(weakest[name], 1.0 / (1.0 + np.exp(-2.0 * np.clip(m, -50, 50))))
        name = min(names, key=lambda n: (-wins[n], -margins[n], n))
        return name, float(p[best] * weakest[name])


def _fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1e-5) -> np.ndarray:
    target = np.eye(classes)[y]
    weight = (1.0 / (classes * np.maximum(target.sum(axis=0), 1)))[y]

    def loss(flat: np.ndarray):
        w = flat.reshape(classes, -1)
        z = (x @ w.T.astype(x.dtype)).astype(float)
        z -= z.max(axis=1, keepdims=True)
        total = np.exp(z).sum(axis=1)
        p = np.exp(z) / total[:, None]
        value = weight @ (np.log(total) - z[np.arange(len(y)), y]) + penalty / 2 * (flat @ flat)
        pull = ((p - target) * weight[:, None]).astype(x.dtype)
        return value, (pull.T @ x).ravel() + penalty * flat

    return minimise(loss, np.zeros(classes * x.shape[1])).reshape(classes, -1)


def _fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Linear support vector machine with squared hinge loss; y is 1 or -1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))

    def loss(w: np.ndarray):
        gap = np.maximum(0.0, 1.0 - y * (x @ w.astype(x.dtype)))
        pull = (-2.0 * weight * gap * y).astype(x.dtype)
        return weight @ gap**2 + penalty / 2 * (w @ w), x.T @ pull + penalty * w

    return minimise(loss, np.zeros(x.shape[1]))


def _sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, lang, pick in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            points = letters(text)
            if not len(points):
                continue
            parts = [points]
            for n, size in enumerate(CUT_LETTERS):
                at = (pick >> (8 * n)) % max(1, len(points) - size)
                parts.append(points[at : at + size])
            out += [(lang, vector(p).astype("<f2").tobytes()) for p in parts]
        yield pa.RecordBatch.from_pydict({"lang": [x[0] for x in out], "vector": [x[1] for x in out]}, pa.schema(
            [("lang", pa.string()), ("vector", pa.binary())]
        ))


def _sample(docs: DataFrame, learn: Column, text: str, lang: str, key: str, per_language: int) -> DataFrame | None:
    """Bounded rows (text, lang, pick) where `learn` holds and the language is known; none without any."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
        F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 2).alias("pick"),
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    most = max(1, min(per_language, SAMPLE_VECTORS // (1 + CUTS) // len(counts)))
    # A language's share of hashes that leaves about `most` rows; the limit makes the bound exact.
    kept = functools.reduce(
        lambda a, b: a | b,
        [(F.col("lang") == name) & (F.col("pick") <= int(min(1.0, most / n) * 2**62)) for name, n in counts.items()],
    )
    return rows.where(kept).limit(2 * most * len(counts))


def fit(
    docs: DataFrame, learn: Column, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
    per_language: int = PER_LANGUAGE, families: dict[str, str] = FAMILIES,
) -> LanguageModel:
    """Fit on a bounded sample of the rows where `learn` holds and the language is known."""
    sample = _sample(docs, learn, text, lang, key, per_language)
    if sample is None:
        return LanguageModel([], [], np.zeros((0, FEATURES + 1)), {}, {})
    found = sample.mapInArrow(_sample_vectors, "lang string, vector binary").collect()
    names = sorted({r["lang"] for r in found})
    if not names:
        return LanguageModel([], [], np.zeros((0, FEATURES + 1)), {}, {})
    x = np.stack([np.frombuffer(r["vector"], "<f2") for r in found]).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    of = np.array([r["lang"] for r in found])
    members: dict[str, list[str]] = {}
    for name in names:
        members.setdefault(family(name, families), []).append(name)
    groups = sorted(members)
    group_of = np.array([groups.index(family(name, families)) for name in of])
    weights = _fit_softmax(x, group_of, len(groups)) if len(groups) > 1 else np.zeros((1, x.shape[1]))
    pairs = {}
    for own in members.values():
        for a, b in itertools.combinations(own, 2):
            rows_ab = (of == a) | (of == b)
            pairs[a, b] = _fit_svm(x[rows_ab], np.where(of[rows_ab] == a, 1.0, -1.0))
    return LanguageModel(names, groups, weights, members, pairs)


def _sample_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, sets, shares = [], [], []
        for text, lang in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            points = letters(text)
            if not len(points):
                continue
            slots, times = np.unique(trigrams(points), return_counts=True)
            langs.append(lang)
            sets.append(slots.astype("<u2").tobytes())
            shares.append((times / times.sum()).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"lang": langs, "slots": sets, "shares": shares}, pa.schema(
            [("lang", pa.string()), ("slots", pa.binary()), ("shares", pa.binary())]
        ))


def fit_known(
    docs: DataFrame, learn: Column, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
    per_language: int = PER_LANGUAGE,
) -> Known:
    """Trigrams of the sample that `fit` takes; at most 2 ** SLOT_BITS of a text reach the driver.

    A text's own share is of the slots that other texts of its language have.
    A language with one text in the sample has no such slots and admits every text.
    """
    sample = _sample(docs, learn, text, lang, key, per_language)
    if sample is None:
        return Known({}, {})
    texts: dict[str, list] = {}
    for r in sample.mapInArrow(_sample_slots, "lang string, slots binary, shares binary").toLocalIterator():
        texts.setdefault(r["lang"], []).append((np.frombuffer(r["slots"], "<u2"), np.frombuffer(r["shares"], "<f4")))
    seen, least = {}, {}
    for name, own in texts.items():
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for slots, _ in own:
            counts[slots] += 1
        usual = np.quantile([shares[counts[slots] > 1].sum() for slots, shares in own], UNUSUAL)
        seen[name], least[name] = counts > 0, float(np.clip(usual - SHARE_SLACK, 0.0, 1.0))
    return Known(seen, least)


def is_known(text: Column, model: LanguageModel, known: Known) -> Column:
    """Whether a text is in the language that the model names, and not only closest to it."""

    @F.arrow_udf("boolean")
    def in_known_language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in handed_back(batches):
            found = []
            for at in range(0, len(batch), 512):
                found += [known.holds(letters(t), model.predict(t)[0]) for t in batch.slice(at, 512).to_pylist()]
            yield pa.array(found, pa.bool_())

    return in_known_language(text.cast("string"))


def predict(text: Column, model: LanguageModel) -> Column:
    """Struct of the predicted language and a score from 0 to 1."""

    @F.arrow_udf("lang string, score double")
    def hierarchical_language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                found = [model.predict(t) for t in batch.slice(at, 512).to_pylist()]
                yield pa.StructArray.from_arrays(
                    [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    ["lang", "score"],
                )

    return hierarchical_language(text.cast("string"))
