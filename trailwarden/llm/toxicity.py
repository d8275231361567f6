"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits and signs that stand
for letters inside a word), reduced to words between single spaces and matched
by one Aho-Corasick automaton.  An entry is a whole word (`` word ``) or a word
beginning (`` stem``) with a weight, and of the entries met at one word the
longest counts; an exception phrase is an entry of negative weight that takes
back whatever is met at the words inside it.  The summed weight is divided by
the number of words, and a logistic curve turns that density and the number of
distinct entries met (and not taken back) into a score.

Weights and curve are learned from a sample of at most ``max_rows`` labelled
rows: the weight is the smoothed log-odds of a term's document counts.  A stem
is an entry only where several different words support it; of stems inside
each other that the same words support, the longest stays.  Exception phrases
are word pairs around a word that any entry matches which are met in documents
of label 0 only.

Defined results: a null or empty text has density 0 and gets the curve's score
for it; without any usable label of both kinds the lexicon is empty and every
score is 0; repeated rows are scored each; other columns are left out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged, text_slices
from .labelled import fold, training_rows

MAX_ROWS = 12_000
STEMS = (4, 5, 6)
MIN_DOCS = 5
MIN_ODDS = 2.0
SUPPORT_DOCS, SUPPORT_WORDS = 2, 2  # documents of label 1 that make a word support its stems, and words that make a stem

# letters of other scripts that look like Latin ones
_LOOK_ALIKE = dict(zip("аеорсухкмтвнігѕјԁһԛԝαβεικνορτυχωΑΒΕΙΚΝΟΡΤΥΧ", "aeopcyxkmtbhirsjdhqwabeiknoptuxwabeiknoptyx"))
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}
_INSIDE = re.compile(r"(?<=[a-z])[0134578](?=[a-z0-9])|[0134578](?=[a-z])|[0134578](?=[0134578]+[a-z])|(?<=[a-z])[01345](?![a-z0-9])"
                     r"|[@$!€](?=[a-z])|(?<=[a-z])[@$](?=[0-9a-z])")
_GAP = re.compile(r"[^a-z0-9]+")


class _Letters(dict):
    """Lower-case Latin base letter of every character, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = _LOOK_ALIKE.get(c, c).lower()
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        self[code] = "".join(_LOOK_ALIKE.get(x, x) for x in base).replace("ß", "ss")
        return self[code]


_LETTERS = _Letters()


def fold_text(text: str) -> str:
    """Folded words, one space between and around them."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    text = _INSIDE.sub(lambda m: _STANDS_FOR[m[0]], text)
    return f" {_GAP.sub(' ', text).strip()} "


def terms_of(folded: str) -> set[str]:
    words = set(folded.split())
    stems = {f" {w[:n]}" for w in words for n in STEMS if len(w) >= n}
    return stems | {f" {w} " for w in words if len(w) > 2}


@dataclass
class Lexicon:
    """Entries with weights, and the curve ``intercept + density + distinct`` coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-math.inf, 0.0, 0.0)
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._automaton.add_word(term, (term, weight))
            if self.weights:
                self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "_automaton": None}

    def entry(self, word: str) -> str | None:
        """The longest entry that is met at a folded word."""
        for term in (f" {word} ", *(f" {word[:n]}" for n in reversed(STEMS) if n <= len(word))):
            if self.weights.get(term, 0.0) > 0:
                return term
        return None

    def features(self, text: str) -> tuple[float, float]:
        """Summed weight per hundred words and log of 1 + distinct entries met, without those inside exception phrases."""
        if not self.weights or not text:
            return 0.0, 0.0
        folded = fold_text(text)
        met, back = {}, set()
        for end, (term, weight) in self.automaton().iter(folded):
            start = end - len(term) + 1
            if weight > 0:
                met[start] = term, weight  # the longest at a word ends last
            else:
                back.update(range(start, end))
        held = [x for start, x in met.items() if start not in back]
        words = max(1, folded.count(" ") - 1)
        return 100.0 * sum(weight for _, weight in held) / words, math.log1p(len({term for term, _ in held}))

    def score(self, density: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(a + b * np.log1p(density) + c * distinct)))


def _term_counts(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in (b for whole in batches for b in text_slices(whole)):
            ones, zeros = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                (ones if label else zeros).update(terms_of(fold_text(text)))
            terms = list(ones.keys() | zeros.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([ones[t] for t in terms], pa.int64()),
                 pa.array([zeros[t] for t in terms], pa.int64())], ["term", "ones", "zeros"])

    return rows.mapInArrow(run, "term string, ones long, zeros long").groupBy("term").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def _supported(found: DataFrame) -> DataFrame:
    """``term, support``: stems, and how many of the found words begin with each, where several do."""
    stems = F.explode(F.array(*[F.substring("term", 1, n + 1) for n in STEMS]))
    words = found.where(F.col("term").endswith(" ")).select(stems.alias("term")).where(~F.col("term").endswith(" "))
    return words.groupBy("term").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT_WORDS)


def _entries(weights: dict[str, float], support: dict[str, int]) -> dict[str, float]:
    """Without the stems that no other words support than a longer stem."""
    held, most = {}, {}  # most: the largest support of a longer stem that begins so
    for term in sorted(weights, key=len, reverse=True):
        stem = not term.endswith(" ")
        if stem and most.get(term, 0) >= support[term]:
            continue
        held[term] = weights[term]
        for n in STEMS if stem else ():
            if n + 1 < len(term):
                most[term[:n + 1]] = max(most.get(term[:n + 1], 0), support[term])
    return held


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Word pairs around the words that an entry matches, by label."""
    def run(batches):
        for batch in (b for whole in batches for b in text_slices(whole)):
            ones, zeros = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                split = fold_text(text).split()
                words = {w for w in set(split) if lexicon.entry(w)}
                pairs = {f" {a} {b} " for a, b in zip(split, split[1:]) if a in words or b in words} if words else ()
                (ones if label else zeros).update(pairs)
            terms = list(ones.keys() | zeros.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([ones[t] for t in terms], pa.int64()),
                 pa.array([zeros[t] for t in terms], pa.int64())], ["term", "ones", "zeros"])

    return rows.mapInArrow(run, "term string, ones long, zeros long").groupBy("term").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def fit(training: DataFrame) -> Lexicon:
    """Learn from ``text, label`` rows; the rows are bounded by the caller, and so is all that is collected here."""
    rows = staged(training.select("text", "label").repartition(8), "toxicity-training")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon()
    odds = F.log((F.col("ones") + 0.5) / (n1 + 1.0)) - F.log((F.col("zeros") + 0.5) / (n0 + 1.0))
    spread = F.sqrt(1 / (F.col("ones") + 0.5) + 1 / (F.col("zeros") + 0.5))
    found = staged(_term_counts(rows).where(F.col("ones") >= SUPPORT_DOCS).withColumn("odds", odds).where(
        F.col("odds") >= MIN_ODDS), "toxicity-terms")
    chosen = found.where((F.col("ones") >= MIN_DOCS) & (F.col("odds") / spread >= 3.0)).join(_supported(found), "term", "left").where(
        F.col("term").endswith(" ") | F.col("support").isNotNull())
    top = chosen.orderBy(F.col("odds").desc(), "term").select("term", "odds", "support").collect()
    lexicon = Lexicon(_entries({r["term"]: float(r["odds"]) for r in top}, {r["term"]: r["support"] for r in top}))
    if lexicon.weights:
        pairs = _exceptions(rows, lexicon).where((F.col("zeros") >= MIN_DOCS) & (F.col("ones") == 0)).orderBy(
            F.col("zeros").desc(), "term").collect()
        back = {r["term"]: -sum(lexicon.weights.get(lexicon.entry(w), 0.0) for w in r["term"].split()) for r in pairs}
        lexicon = Lexicon(lexicon.weights | back)
    lexicon.curve = _curve(rows, lexicon)
    return lexicon


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton steps, classes weighed evenly at the middle."""
    def run(batches):
        for batch in (b for whole in batches for b in text_slices(whole)):
            pairs = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), batch.column("label")], ["d", "m", "label"])

    got = rows.mapInArrow(run, "d double, m double, label int").toPandas()
    x = np.column_stack([np.ones(len(got)), np.log1p(got["d"]), got["m"]])
    y = got["label"].to_numpy(float)
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - np.array([0.0, 0.05, 0.05]) * beta
        hessian = (x.T * (p * (1 - p))) @ x + np.diag([1e-6, 0.05, 0.05])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: one row per input row, no shuffle."""
    def run(batches):
        for batch in (b for whole in batches for b in text_slices(whole)):
            pairs = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            d, m = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lexicon.score(d, m))], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (all columns as they are) that score below ``threshold``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            pairs = [lexicon.features(t or "") for t in batch.column(at).to_pylist()]
            d, m = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
            yield batch.filter(pa.array(lexicon.score(d, m) < threshold))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, held_out: int = 0,
          max_rows: int = MAX_ROWS) -> Lexicon:
    return fit(training_rows(docs, labels, label_col, folds, held_out, max_rows))


def predictions(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """Contract form."""
    scored = score(docs, learn(docs, labels, folds=folds, held_out=held_out))
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
