"""Language identification in two steps (operator 7): family first, then pairs within the family.

A text is a unit vector of hashed byte n-grams (1 to 3 bytes, ASCII lowered, ASCII non-letters as one
blank kind).  A one-against-the-rest linear support vector machine per family picks the family; inside it,
one-versus-one linear support vector machines separate every pair of its languages and vote (summed
margins break ties, then the smaller code).  The score is the logistic of the family margin times the mean
logistic of the winner's pair margins.

Families come from ``FAMILIES`` (a parameter); a code it lacks is a family of its own.  Fitting uses at
most ``max_rows`` texts per language, chosen by hash of their ids, so the driver holds at most
languages x ``max_rows`` vectors of ``DIMS`` half-precision numbers; each machine sees at most ``max_rows``
texts a side.  Prediction is one narrow pass over whole texts.

Texts that are null or have no letter are ``und`` with score 0.  If no row can be learned from, all are.
Null labels are not learned from.  Repeated rows are predicted alike.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_array, held, prepare, text_buffer, text_slices

DIMS = 1 << 12
MAX_ROWS = 400
UNKNOWN = "und"
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
}
LETTER = regex.compile(r"\p{L}")
#: ASCII letters lowered, bytes of other characters kept, all else one blank
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)


def vectors(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors (square roots of relative n-gram frequencies) of the texts of a flat buffer."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    b = FOLD[buf]
    out = np.zeros(n * DIMS)
    gram = np.zeros(len(b), np.uint32)
    for k in range(3):
        # grams of k + 1 bytes that end inside the row they began in
        m = len(b) - k
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(0x01000193) ^ (b[k:] + np.uint32(1))
        inside = row[:m] == row[k:]
        h = (gram * np.uint32(0x9E3779B1) + np.uint32(k * 0x05EBCA6B)) >> np.uint32(20)
        out += np.bincount(row[:m][inside] * DIMS + h[inside], minlength=n * DIMS)
    out = out.reshape(n, DIMS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 30) -> np.ndarray:
    """Weights and intercept of an L2-loss support vector machine, by Newton steps over its Gram matrix."""
    z = np.c_[x.astype(np.float64), np.ones(len(x))]
    gram = z @ z.T
    w_of = np.zeros(len(y))
    active = np.ones(len(y), bool)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(rounds):
        a = np.flatnonzero(active)
        w_of[:] = 0
        w_of[a] = np.linalg.solve(gram[np.ix_(a, a)] + np.diag(ridge * len(y) / weight[a]), y[a])
        now = y * (gram @ w_of) < 1
        if (now == active).all():
            break
        active = now
    return z.T @ w_of


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    pair_w: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.c_[x, np.ones(len(x), np.float32)]
        code, score = np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        if not self.families or not len(x):
            return code, score
        if len(self.families) > 1:
            margin = z @ self.family_w
            family, sure = margin.argmax(axis=1), logistic(margin.max(axis=1))
        else:
            family, sure = np.zeros(len(x), np.int64), np.ones(len(x))
        for f, name in enumerate(self.families):
            at = np.flatnonzero(family == f)
            langs = self.languages[name]
            if not len(at):
                continue
            votes, margins, belief = (np.zeros((len(at), len(langs))) for _ in range(3))
            pairs = list(itertools.combinations(range(len(langs)), 2))
            if pairs:
                m = z[at] @ self.pair_w[name]
                for p, (i, j) in enumerate(pairs):
                    for lang, side in ((i, m[:, p]), (j, -m[:, p])):
                        votes[:, lang] += side > 0
                        margins[:, lang] += side
                        belief[:, lang] += logistic(side)
                belief /= len(langs) - 1
            else:
                belief += 1
            best = (votes + 1e-3 * np.tanh(margins / 100)).argmax(axis=1)
            code[at] = np.array(langs, object)[best]
            score[at] = sure[at] * belief[np.arange(len(at)), best]
        return code, score


def logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(m, -15, 15)))


def learn(x: np.ndarray, lang: np.ndarray, families: dict[str, str], max_rows: int) -> Model:
    model = Model()
    names = sorted(set(lang))
    family = np.array([families.get(v, f"only:{v}") for v in lang], object)
    model.families = sorted(set(family))
    for f in model.families:
        model.languages[f] = [v for v in names if families.get(v, f"only:{v}") == f]
    rng = np.random.default_rng(0)

    def side(mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return at if len(at) <= max_rows else np.sort(rng.choice(at, max_rows, replace=False))

    def machine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.r_[side(a), side(b)]
        return linear_svm(x[at], np.where(a[at], 1.0, -1.0))

    if len(model.families) > 1:
        model.family_w = np.stack([machine(family == f, family != f) for f in model.families], axis=1).astype(np.float32)
    for f in model.families:
        pairs = [machine(lang == a, lang == b) for a, b in itertools.combinations(model.languages[f], 2)]
        if pairs:
            model.pair_w[f] = np.stack(pairs, axis=1).astype(np.float32)
    return model


def fit(docs: DataFrame, usable: Column | None = None, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        families: dict[str, str] | None = None, max_rows: int = MAX_ROWS):
    """A broadcast ``Model`` from at most ``max_rows`` labelled texts of each language; ``usable`` says which rows may teach."""
    prepare(docs)
    spark = docs.sparkSession
    rows = docs if usable is None else docs.where(usable)
    rows = rows.select(F.col(key).alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return spark.sparkContext.broadcast(Model())
    # thin by hash before ranking, so that ranking sees about twice max_rows of each language
    share = F.create_map(*itertools.chain.from_iterable((F.lit(v), F.lit(min(1.0, 2 * max_rows / c + 20 / c))) for v, c in counts.items()))
    order = F.xxhash64(F.col("k").cast("string"), F.lit(7))
    thin = rows.where(F.pmod(order, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    picked = thin.withColumn("o", order).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "k", "text"))).where(F.col("r") <= max_rows)

    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(column_array(batch, "text"))
            for lo, hi, b, off in text_slices(buf, offsets, 1 << 19):
                x = vectors(b, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([column_array(batch, "lang").slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    got = picked.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    return spark.sparkContext.broadcast(learn(x, np.array(got["lang"].to_pylist(), object), FAMILIES if families is None else families, max_rows))


ROWS_AT_ONCE = 256


def predict(docs: DataFrame, shared, text_col: str = "text") -> DataFrame:
    """``docs`` with [lang_pred, score] added (replacing columns of those names)."""
    prepare(docs)
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    schema = T.StructType(kept + made)

    def run(batches):
        for batch in batches:
            text = column_array(batch, text_col)
            letters = np.array([t.is_valid and LETTER.search(t.as_py()) is not None for t in text], bool)
            buf, offsets = text_buffer(text)
            codes, scores = [], []
            for lo in range(0, len(text), ROWS_AT_ONCE):
                hi = min(len(text), lo + ROWS_AT_ONCE)
                for _, _, b, off in text_slices(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]):
                    code, score = shared.value.predict(vectors(b, off))
                    codes.append(code)
                    scores.append(score)
            code, score = (np.concatenate(v) if v else np.zeros(0) for v in (codes, scores))
            yield pa.RecordBatch.from_arrays([*(column_array(batch, f.name) for f in kept), pa.array(np.where(letters, code, UNKNOWN), pa.string()),
                                              pa.array(np.where(letters, score, 0.0).astype(np.float64))], names=schema.names)

    return docs.select(*[docs[f"`{f.name}`"] for f in kept]).mapInArrow(run, schema)
