"""Language ID by hierarchical discrimination.

First the language family, then the language within it.  Families are told apart by linear
support vector machines, one against the rest; the languages of one family by linear machines
for each pair, whose votes decide.  Features are frequencies of hashed byte pairs and triples
of the letters (ASCII letters lowered, everything beyond ASCII as it is, all else a blank),
over the whole text.

Training draws at most ``per_language`` documents of each language (those of smallest hashed
id) and at most ``most_rows`` in all; only their feature vectors reach the driver, so what is
gathered is bounded whatever the table holds.  Prediction is one pass without a shuffle: each
machine is a table of weights by n-gram, averaged over a text's n-grams through prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import anonymous, arrow_map, batch

BITS = 12
SIZE = 1 << BITS
UNKNOWN = "und"
_CONSTANT = 0.3
_SCALE = np.float32(1024)
#: Bytes of texts that are scored at once, which take about 50 times as much while they are.
CHUNK_BYTES = 1 << 18

# ISO 639-1 codes of well-known families.  A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_BYTES = np.arange(256)
_LETTERS = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, np.where(((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80), _BYTES, 0x20)).astype(np.uint8)
_ASCII_LETTER = (_LETTERS > 0x20) & (_BYTES < 0x80)


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def _ngrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the feature of the pair and of the triple that begin with it (two bytes of padding)."""
    b = np.append(_LETTERS[data], [0x20, 0x20]).astype(np.uint32)
    pair = b[:-1] << np.uint32(8) | b[1:]
    triple = (pair[:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    return (pair[:-1] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), (triple >> np.uint32(32 - BITS)) + np.uint32(SIZE)


def features(text: bytes) -> np.ndarray:
    """Frequencies of the pairs and triples of one text."""
    pair, triple = _ngrams(np.frombuffer(text, np.uint8))
    counts = np.bincount(np.concatenate([pair, triple]), minlength=2 * SIZE)
    return (counts / max(1, len(text))).astype(np.float32)


def _svm(gram: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Signed dual weights of a linear machine with hinge loss, by coordinate descent.

    gram: inner products of the rows; y: 1 or -1.  Both classes weigh the same in all.
    """
    alpha, outputs = np.zeros(len(y)), np.zeros(len(y))
    norm = np.maximum(gram.diagonal(), 1e-9)
    order, random = np.arange(len(y)), np.random.default_rng(seed)
    most = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(rounds):
        random.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            new = min(max(alpha[i] - (y[i] * outputs[i] - 1) / norm[i], 0), most[i])
            step = new - alpha[i]
            if step:
                outputs += (step * y[i]) * gram[i]
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return alpha * y


@dataclass
class Model:
    """Machines as columns of weights by feature; the last row is the constant."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((2 * SIZE + 1, 0), np.float32))
    column: dict[tuple, int] = field(default_factory=dict)

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A language and a score for each row of margins."""
        n = len(margins)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        which, sure = self._family(margins)
        langs, scores = np.empty(n, object), sure.copy()
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(which == k)
            choice, share = self._within(name, margins[rows])
            langs[rows] = choice
            scores[rows] *= share
        return langs.tolist(), scores

    def _family(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.families) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        m = np.stack([margins[:, self.column["family", f]] for f in self.families], axis=1)
        best = m.argmax(axis=1)
        rest = np.where(np.arange(m.shape[1]) == best[:, None], -np.inf, m).max(axis=1)
        return best, _sigmoid(m.max(axis=1) - rest)

    def _within(self, name: str, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = self.languages[name]
        votes = np.zeros((len(margins), len(names)))
        for i, j in combinations(range(len(names)), 2):
            p = _sigmoid(2 * margins[:, self.column["pair", names[i], names[j]]])
            votes[:, i] += (p >= 0.5) + p / len(names)
            votes[:, j] += (p < 0.5) + (1 - p) / len(names)
        best = votes.argmax(axis=1) if len(names) > 1 else np.zeros(len(margins), int)
        sure = np.ones(len(margins))
        for i, j in combinations(range(len(names)), 2):
            p = _sigmoid(2 * margins[:, self.column["pair", names[i], names[j]]])
            sure = np.where(best == i, np.minimum(sure, p), np.where(best == j, np.minimum(sure, 1 - p), sure))
        return np.array(names, object)[best], sure


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """Machines from (language, packed features) rows; without rows, a model that knows no language."""
    model = Model()
    if not rows:
        return model
    langs = np.array([r[0] for r in rows], object)
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32) / _SCALE
    kin = np.array([family(v) for v in langs], object)
    model.families = sorted(set(kin))
    model.languages = {f: sorted(set(langs[kin == f])) for f in model.families}
    mean, scale = x.mean(axis=0), 1 / (x.std(axis=0) + np.float32(1e-3)) / np.float32(np.sqrt(x.shape[1]))
    x -= mean
    x *= scale
    x = np.hstack([x, np.full((len(x), 1), _CONSTANT, np.float32)])
    columns = []

    def add(key: tuple, rows: np.ndarray, y: np.ndarray) -> None:
        own = x[rows]
        w = own.T @ _svm((own @ own.T).astype(np.float64), y).astype(np.float32)
        w = w / (np.median(np.abs(own @ w)) + 1e-9) * 2
        model.column[key] = len(columns)
        columns.append(np.append(w[:-1] * scale, _CONSTANT * w[-1] - (mean * scale) @ w[:-1]))

    if len(model.families) > 1:
        for f in model.families:
            add(("family", f), np.arange(len(x)), np.where(kin == f, 1.0, -1.0))
    for names in model.languages.values():
        for a, b in combinations(names, 2):
            rows_ab = np.flatnonzero((langs == a) | (langs == b))
            add(("pair", a, b), rows_ab, np.where(langs[rows_ab] == a, 1.0, -1.0))
    model.weights = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((2 * SIZE + 1, 0), np.float32)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def _packed(text: bytes) -> bytes:
    """Features in half precision, scaled into its range: half the bytes for the driver."""
    return (features(text) * _SCALE).astype(np.float16).tobytes()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts, and for each a passage from its middle, so that short texts are met too."""
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            whole = text.encode()
            words = whole.split()
            short = b" ".join(words[len(words) // 2 :][:8])
            yield batch(lang=[lang, lang], vector=pa.array([_packed(whole), _packed(short)], pa.binary()))


def train(docs: DataFrame, per_language: int = 200, most_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from a bounded sample of the documents whose fold is not 1.

    Rows without a language or text are left out.  ``most_rows`` bounds the sample when there
    are many languages; each then gives fewer documents.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & (F.length("text") > 0))
    by = (F.xxhash64("doc_id"), F.col("doc_id"))
    # First within shares of each language, so that a language of most rows is not one task.
    shares = labelled.select("doc_id", "lang").withColumn("share", F.pmod(F.hash("doc_id"), F.lit(64)))
    first = shares.withColumn("n", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by))).where(F.col("n") <= per_language).select("doc_id", "lang")
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("n") <= per_language)
    # At most most_rows ids, which are not made into a table by the driver: that would start Python workers of its own kind.
    wanted = ranked.orderBy("n", "lang").limit(most_rows).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    sample = labelled.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi").select("doc_id", "lang", "text")
    once = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = arrow_map(once, _vectors, "lang string, vector binary").collect()  # at most 2 * most_rows vectors
    return fit(sorted((r.lang, bytes(r.vector)) for r in rows))


def _scores(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    letters = np.append(0, np.cumsum(_ASCII_LETTER[data]))
    lettered = letters[ends] > letters[begins]
    for k in np.flatnonzero(~lettered):
        lettered[k] = any(c.isalpha() for c in texts[k].decode())
    # Features as in features(): each text ends in two blanks, whatever follows it in the chunk.
    padded = np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)
    shift = 2 * np.arange(len(texts))
    pair, triple = _ngrams(padded)
    n = np.maximum(1, ends - begins)
    margins = np.empty((len(texts), model.weights.shape[1]))
    for k in range(model.weights.shape[1]):
        w = np.ascontiguousarray(model.weights[:, k])
        sums = np.append(0, np.cumsum(w[pair] + w[triple], dtype=np.float64))
        margins[:, k] = (sums[ends + shift] - sums[begins + shift]) / n + model.weights[-1, k]
    langs, scores = model.predict(margins)
    return [v if ok else UNKNOWN for v, ok in zip(langs, lettered.tolist(), strict=True)], np.where(lettered, scores, 0.0)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = 0
            while i < b.num_rows:
                texts, size = [], 0
                while i + len(texts) < b.num_rows and (not texts or size < CHUNK_BYTES):
                    texts.append((b.column("text")[i + len(texts)].as_py() or "").encode())
                    size += len(texts[-1])
                langs, scores = _scores(model, texts)
                held = b.schema.names[:-1]
                yield batch(**{c: b.column(c).slice(i, len(texts)) for c in held}, lang_pred=pa.array(langs, pa.string()), score=scores)
                i += len(texts)

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for each row; the prediction sees the text alone.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or the model
    knows no language.  Whole texts count, however long.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(source, _predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


#: Below this score a text is in no learned language.  On held-out rows of the small tables the least score of any is 0.34, so it takes none of them.
LEAST_SCORE = 0.25


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """``docs`` less the rows in no known language, with all columns as they were.

    A text without a letter goes, and so does one whose prediction has a score below ``least``.
    A model that has learned no language rejects no text that has a letter.
    """
    plain, names, fields = anonymous(docs)
    text = F.col(names[docs.columns.index(text_col)]).cast("string")
    if not model.families:
        return plain.where(text.rlike(r"\p{L}")).toDF(*docs.columns)
    judged = arrow_map(plain.withColumn("text", text), _predict(model), f"{fields}, lang_pred string, score double")
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*names).toDF(*docs.columns)
