"""Token counts from a tokenizer that is compiled to a finite-state transducer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import remembered, texts
from fleetlens.llm.vocabulary import MARKER, Vocabulary, read_vocabulary

#: Characters of a text that are turned into one state map.
CHUNK = 1 << 16
#: Words, and transitions, that a worker remembers.
REMEMBERED = 600_000
REMEMBERED_STEPS = 500_000


class Transducer:
    """Merges by score (byte fallback for the rest) as a deterministic transducer.

    For every prefix of a text there is one last token such that the rest is the
    tokenization of what stands before it: the one token that ends the prefix and
    that no merge joins to the last token before it. So reading a character needs
    only the last tokens at the few earlier places from which a piece can still
    go on. That tuple (place in the trie, last token there, tokens since) is a
    state; a transition is annotated with the change of the number of tokens.
    States and transitions are made when first met, then looked up.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.scores = {p: s for p, _, s in vocabulary.pieces}
        self.words_apart = vocabulary.words_apart
        self.history: dict[str, tuple[list[float], list[str], list[str]]] = {}
        self.trie: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        singles = {c for p in self.scores for c in p}
        for piece in [*self.scores, *sorted(singles - set(self.scores))]:
            if len(piece) > 1 and self.merge(piece) != [piece]:
                continue  # never the result of merges
            at = 0
            for c in piece:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(None)
                at = self.trie[at][c]
            self.ends[at] = piece
        self.weight = {c: len(c.encode()) for c in singles - set(self.scores)}
        self._forget()

    def _forget(self) -> None:
        self.apart: dict[tuple[str, str], bool] = {}
        self.states = {((0, "", 0),): 0}
        self.keys = [((0, "", 0),)]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.known: dict[str, int] = {}
        self.made = 0

    def merge(self, text: str) -> list[str]:
        """The merges themselves; used to compile, on short strings."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _merges(self, token: str) -> tuple[list[float], list[str], list[str]]:
        """Scores of the merges that make a token, in order, and its first and last
        part before each of them and at the end."""
        if token not in self.history:
            parts, scores, first, last = list(token), [], [token[0]], [token[-1]]
            while len(parts) > 1:
                score, i = min((-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                scores.append(-score)
                first.append(parts[0])
                last.append(parts[-1])
            scores.append(-math.inf)
            self.history[token] = scores, first, last
        return self.history[token]

    def _stay_apart(self, a: str, b: str) -> bool:
        """No merge joins the tokens: both are made side by side, always by the best
        merge, the left one of equals, and none between them is ever the best."""
        if not a:
            return True
        known = self.apart.get((a, b))
        if known is None:
            (left, _, last), (right, first, _) = self._merges(a), self._merges(b)
            i = j = 0
            while True:
                x, y, between = left[i], right[j], self.scores.get(last[i] + first[j])
                if between is not None and between > x and between >= y:
                    known = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    known = True
                    break
                if j + 1 == len(right) or (i + 1 < len(left) and x >= y):
                    i += 1
                else:
                    j += 1
            self.apart[a, b] = known
        return known

    def _step(self, state: int, c: str) -> tuple[int, int]:
        alive, last, change = [], None, 0
        for node, token, since in self.keys[state]:
            child = self.trie[node].get(c)
            if child is None:
                continue
            alive.append((child, token, since))
            end = self.ends[child]
            if end is not None and last is None and self._stay_apart(token, end):
                last, change = end, since + self.weight.get(end, 1)
        if last is None:  # a character of no piece: its bytes
            key, change = ((0, "", 0),), len(c.encode("utf-8", "surrogatepass"))
        else:
            live = [(n, t, s - change) for n, t, s in alive if self.trie[n]]
            key = ((0, last, 0), *live)
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        self.made += 1
        step = self.steps[state][c] = (self.states[key], change)
        return step

    def word(self, word: str) -> int:
        """Tokens of a piece of text that stands by itself; markers for spaces."""
        n = self.known.get(word)
        if n is None:
            state = n = 0
            for c in word:
                state, change = self.steps[state].get(c) or self._step(state, c)
                n += change
            if self.made > REMEMBERED_STEPS:
                self._forget()
            if len(self.known) > REMEMBERED:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = n
        return n

    def count(self, text: str) -> int:
        if not self.words_apart:
            return self.word(text)
        word, known, n = self.word, self.known.get, 0
        for w in _WORD.findall(text):
            n += known(w) or word(w)
        return n


_WORD = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
_START = re.compile(f"(?<=[^{MARKER}]){MARKER}")


@dataclass(frozen=True)
class StateMap:
    """What a chunk does from any state: ``head`` is read on from the state before,
    then a word starts and the state is the same whatever came before; ``tokens``
    are those of the whole words, ``tail`` is the last word, still open. Without
    any word start, ``tokens`` is None and the head is all of the chunk."""

    head: str
    tokens: int | None = None
    tail: str = ""


def state_map(chunk: str, machine: Transducer) -> StateMap:
    first = _START.search(chunk) if machine.words_apart else None
    if first is None:
        return StateMap(chunk)
    end = len(chunk)
    while end > first.start() and chunk[end - 1] == MARKER:
        end -= 1
    # An open run of markers belongs to the last word, which starts where it does.
    last = end if end < len(chunk) else chunk.rindex(MARKER) if chunk[-1] != MARKER else end
    while last > first.start() and chunk[last - 1] == MARKER:
        last -= 1
    last = max(last, first.start())
    return StateMap(chunk[: first.start()], machine.count(chunk[first.start() : last]), chunk[last:])


def compose(a: StateMap, b: StateMap, machine: Transducer) -> StateMap:
    """The map of two neighbouring chunks; associative."""
    if a.tokens is None and b.tokens is None:
        joined = a.head + b.head
        return state_map(joined, machine)
    if a.tokens is None:
        left = state_map(a.head + b.head, machine)
        if left.tokens is None:
            return StateMap(left.head, b.tokens, b.tail)
        return StateMap(left.head, left.tokens + machine.count(left.tail) + b.tokens, b.tail)
    if b.tokens is None:
        return StateMap(a.head, a.tokens, a.tail + b.head)
    return StateMap(a.head, a.tokens + machine.count(a.tail + b.head) + b.tokens, b.tail)


def scan(maps: list[StateMap], machine: Transducer) -> StateMap:
    """Compose neighbours in rounds, as a parallel prefix scan does."""
    while len(maps) > 1:
        pairs = [compose(a, b, machine) for a, b in zip(maps[::2], maps[1::2])]
        maps = pairs + maps[len(maps) - len(maps) % 2 :]
    return maps[0]


def count_tokens(text: str, machine: Transducer, chunk: int = CHUNK) -> int:
    """Tokens of a text, after the marker that the model puts before every text."""
    if not text:
        return 0
    text = MARKER + text.replace(" ", MARKER)
    if len(text) <= chunk:
        return machine.count(text)
    whole = scan([state_map(text[i : i + chunk], machine) for i in range(0, len(text), chunk)], machine)
    if whole.tokens is None:
        return machine.count(whole.head)
    return machine.count(whole.head) + whole.tokens + machine.count(whole.tail)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs(doc_id, text)``.

    The counts are those of the SentencePiece library for a merge model with byte
    fallback and no normalization. A null text is empty and has 0 tokens; rows and
    doc_ids, null or repeated, are returned as they come; other columns are not
    looked at. No shuffle: a text is counted where it is read, long ones chunk by
    chunk, and words come from a bounded memory of the worker.
    """
    vocabulary = read_vocabulary(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = remembered(("transducer", model_path), lambda: Transducer(vocabulary))
        for batch in batches:
            values = [count_tokens(t, machine) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(values, pa.int64())], schema=schema
            )

    sized = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
