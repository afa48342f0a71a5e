"""Toxicity from a weighted finite-state grammar over the clauses of a text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import WordHashes, forget, keep, shingles, texts, tidy

#: Labelled documents that the lexicon and the weights are learned from, at most.
SAMPLE = 20_000
#: Learned word patterns, at most.
PATTERNS = 1000

# Closed classes of function words and a few plain insults and threats
# in English, German, French and Spanish.
INSULTS = "idiot moron stupid loser pathetic worthless scum trash disgusting clown".split()
THREATS = "kill hurt destroy murder töten umbringen tuer tuerai matar mataré".split()
TARGETS = "you your yours he she they them him her du dich dir ihr euch tu te toi vous tú usted ustedes vosotros".split()
NEGATIONS = "not never no isn't aren't wasn't nicht nie kein keine ne pas jamais nunca jamás".split()
REPORTS = "said says say claims claimed called quoted wrote sagte sagt behauptete dit écrit dijo dice escribió".split()

_CLAUSE_END = ".!?;:,\n"
_END = re.compile(r"[.!?;:,\n]")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def transducer(step, start) -> tuple[list, list[dict[str, int]]]:
    """States reachable from ``start`` and their transitions by word class."""
    states, table = [start], []
    for state in states:
        row = {}
        for kind in "ITPNRO":
            after = step(state, kind)
            if after not in states:
                states.append(after)
            row[kind] = states.index(after)
        table.append(row)
    return states, table


def negation(state: int, kind: str) -> int:
    """A negation reaches over the next three words."""
    return 3 if kind == "N" else max(0, state - 1)


def latch(kind: str):
    """Set from the first word of this class to the end of the clause."""
    return lambda state, k: int(state or k == kind)


def composed(*parts):
    """The product of transducers that read the same words."""
    return lambda state, kind: tuple(p(s, kind) for p, s in zip(parts, state, strict=True))


#: Read from left to right: negation and reported speech govern what follows. A
#: target may stand on either side, so it is read in both directions.
FORWARD = transducer(composed(negation, latch("R"), latch("P")), (0, 0, 0))
BACKWARD = transducer(latch("P"), 0)
CONTEXTS = ("plain", "targeted", "negated", "reported")
FEATURES = ("one", *CONTEXTS, "threat", "clauses", "share")


@dataclass(frozen=True)
class Model:
    """``whole`` and ``starts``: weights of words and of word beginnings; ``weights``
    of :data:`FEATURES`."""

    whole: dict[str, float]
    starts: dict[str, float]
    weights: tuple[float, ...]


class Grammar:
    def __init__(self, model: Model) -> None:
        self.whole = {w: 2.0 for w in THREATS} | model.whole
        self.starts, self.threats = model.starts, set(THREATS) - set(model.whole)
        self.lengths = sorted({len(s) for s in self.starts})
        self.classes = {w: k for k, ws in (("P", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws}
        by_letter: dict[str, list[str]] = {}
        for s in sorted(self.starts, key=len, reverse=True):
            by_letter.setdefault(s[0], []).append(re.escape(s[1:]))
        for w in sorted(self.whole):
            by_letter.setdefault(w[0], []).append(re.escape(w[1:]) + r"\b")
        self.trigger = re.compile(r"\b(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(r)})" for c, r in sorted(by_letter.items())) + ")") if by_letter else None

    def weight(self, word: str) -> float:
        found = self.whole.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            found = max(found, self.starts.get(word[:n], 0.0))
        return found

    def kind(self, word: str) -> str:
        if self.weight(word) > 0:
            return "T" if word in self.threats else "I"
        return self.classes.get(word, "O")

    def clause(self, clause: str) -> dict[str, float]:
        """Weights of the matches in a clause, by context."""
        words = _TOKEN.findall(clause)
        kinds = [self.kind(w) for w in words]
        states, table = FORWARD
        after, back = [0] * (len(words) + 1), 0
        targeted = [False] * len(words)
        for i in range(len(words) - 1, -1, -1):
            targeted[i] = bool(BACKWARD[0][back])
            back = BACKWARD[1][back][kinds[i]]
        out: dict[str, float] = Counter()
        for i, (word, kind) in enumerate(zip(words, kinds, strict=True)):
            negated, reported, before = states[after[i]]
            after[i + 1] = table[after[i]][kind]
            if kind not in "IT":
                continue
            weight = self.weight(word)
            if negated:
                out["negated"] += weight
            elif reported:
                out["reported"] += weight
            elif kind == "T":
                out["threat"] += weight * (2 if targeted[i] or before else 1)
            else:
                out["targeted" if targeted[i] or before else "plain"] += weight
        return out

    def features(self, text: str) -> np.ndarray:
        """One row of :data:`FEATURES`. Only clauses with a match are read closely."""
        low = text.lower()
        sums: dict[str, float] = Counter()
        end = clauses = 0
        for match in self.trigger.finditer(low) if self.trigger else ():
            if match.start() < end:
                continue
            start = 1 + max(low.rfind(c, end, match.start()) for c in _CLAUSE_END)
            start = max(start, end)
            mark = _END.search(low, match.end())
            end = mark.start() if mark else len(low)
            clauses += 1
            for k, v in self.clause(low[start:end]).items():
                sums[k] += v
        x = [1.0, *(math.log1p(sums[c]) for c in CONTEXTS), math.log1p(sums["threat"]), math.log1p(clauses)]
        return np.array([*x, 100 * clauses / (len(low) + 100)])


#: Without labels: matched insults and threats count, negated and reported ones hardly.
UNTRAINED = (-3.0, 2.0, 2.5, 0.3, 0.5, 2.0, 0.5, 0.0)


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn the lexicon and the weights from labelled rows that are not held out.

    At most ``sample`` labelled documents are used, those first by a hash of their
    id; documents that share their least shingle count once, so copies do not make
    their words look telling. Word patterns are whole words and beginnings of 4 to
    12 letters that stand in toxic documents much more often than chance among so
    many patterns allows; weights of the context sums are a ridge-penalized
    logistic regression. Several labels of a document: toxic if one is.
    """
    chosen = (
        labels.select("doc_id", "toxic")
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    signed = rows.mapInArrow(_least_shingle, "least long, doc_id long, text string, toxic int")
    rows = keep(
        signed.groupBy("least").agg(F.min_by(F.struct("text", "toxic"), F.struct("doc_id", "text", "toxic")).alias("r")).select("r.*"), "labelled"
    )
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = Model({w: 3.0 for w in INSULTS}, {}, UNTRAINED)
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 5:
        forget(rows)
        return model
    found = rows.filter("toxic = 1").mapInArrow(_patterns(None), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).filter("n >= 4")
    toxic = {r["pattern"]: r["n"] for r in found.collect()}  # patterns of the bounded sample
    wanted = rows.sparkSession.sparkContext.broadcast(set(toxic))
    clean = rows.filter("toxic = 0").mapInArrow(_patterns(wanted), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    clean = {r["pattern"]: r["n"] for r in clean.collect()}
    model = Model(*_lexicon(toxic, clean, sizes), UNTRAINED)
    data = rows.mapInArrow(_features(model), "toxic int, x array<double>").collect()  # of the bounded sample
    forget(rows)
    return Model(model.whole, model.starts, _regression(np.array([r["x"] for r in data]), np.array([r["toxic"] for r in data])))


@tidy
def _least_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        least = [int(s.min() >> np.uint64(1)) if len(s := shingles(known.of(t))) else 0 for t in texts(batch.column("text"))]
        yield pa.RecordBatch.from_pydict(
            {"least": pa.array(least, pa.int64()), "doc_id": batch.column("doc_id").cast(pa.int64()), "text": batch.column("text"), "toxic": batch.column("toxic")}
        )


def _patterns(wanted):
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column("text")):
                words = set(_TOKEN.findall(text.lower()))
                counts.update(p for p in {f"{w}=" for w in words} | {w[:n] for w in words for n in range(4, min(13, len(w) + 1))} if wanted is None or p in wanted.value)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return count


def _lexicon(toxic: dict[str, int], clean: dict[str, int], sizes: dict[int, int]) -> tuple[dict[str, float], dict[str, float]]:
    base = sizes[1] / (sizes[0] + sizes[1])
    chance = math.log(len(toxic) + 1) + 3
    scored = []
    for pattern, a in toxic.items():
        b = clean.get(pattern, 0)
        n = a + b
        gain = a * math.log(a / (n * base)) + (b * math.log(b / (n * (1 - base))) if b else 0.0)
        if a / n >= 0.7 and gain > chance:
            weight = math.log((a + 0.5) / (b + 0.5) * sizes[0] / sizes[1])
            scored.append((-gain, len(pattern), pattern, weight))
    whole, starts = {}, {}
    for _, _, pattern, weight in sorted(scored)[:PATTERNS]:
        word = pattern.removesuffix("=")
        if any(word.startswith(s) for s in starts):
            continue
        if pattern.endswith("="):
            whole[word] = weight
        else:
            starts[word] = weight
    for word in INSULTS:
        a, b = toxic.get(f"{word}=", 0), clean.get(f"{word}=", 0)
        if b <= a:
            whole.setdefault(word, 2.0)
    return whole, starts


def _features(model: Model):
    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for batch in batches:
            x = [grammar.features(t).tolist() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "x": pa.array(x, pa.list_(pa.float64()))})

    return features


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, ...]:
    """Ridge-penalized logistic regression by Newton steps, from the untrained weights."""
    w, prior = np.array(UNTRAINED), np.array(UNTRAINED)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * (w - prior))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    A score depends on the text only. Null and empty texts score as a text without
    a match. Columns of these names that ``docs`` has are replaced.
    """

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, weights = Grammar(model), np.array(model.weights)
        for batch in batches:
            z = [float(grammar.features(t) @ weights) for t in texts(batch.column("text"))]
            values = pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "score"])

    docs = docs.drop("score", "predicted")
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(score, f"{schema}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    return score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)
