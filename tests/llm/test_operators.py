"""Every operator on odd rows, and against a brute-force version."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
import sys
from collections import defaultdict

import numpy as np
import psutil
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import chat, common, linking, minhash, mixing, multiindex, paragraphs, pieces, tokencount, topk, toxicity, warc
from fleetlens.llm.common import WordHashes, shingles
from fleetlens.llm.components import components
from fleetlens.llm.vocabulary import read_vocabulary

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, root string, score string, n_removed string, epoch string"
WORDS = [f"w{i}" for i in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, every: int) -> str:
    return " ".join("x" if i % every == every // 2 else w for i, w in enumerate(text.split()))


def odd_documents() -> list[tuple]:
    a, b, p = prose(120, 1), prose(150, 2), prose(60, 3)
    rows = [
        (1, a, "en", "src1"), (2, a, "en", "src1"), (3, edited(a, 90), None, "src2"), (4, b, "de", None),
        (5, None, None, None), (6, "", "en", "src1"), (None, prose(80, 4), "en", "src1"), (None, a, "en", "src1"),
        (7, f"one\n{p}\n{prose(70, 5)}", "en", "src3"), (8, f"{p}\ntwo\n{p}", "fr", "src3"), (9, f"{edited(p, 55)}\nthree", "fr", "odd"),
        (10, "short", "en", "src1"), (11, " \n\t ", "en", "src1"), (12, prose(30_000, 6), "en", "src2"), (13, "é日本\x00▁ 🙂", "en", "src2"),
        (1, a, "en", "src1"), (14, "idiot. you are a moron, you idiot!", "en", "src1"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), "n", "r", "s", "m", "e") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_are_those_of_words():
    known = WordHashes()
    known.PIECE = 7
    text = "A b  c\n\té ab bA " + "long" * 30 + " a"
    low = text.lower().encode().split()
    found = known.of(text).tolist()
    assert len(found) == len(low) and len(set(found)) == len(set(low))
    assert known.of("a")[0] == found[0] == found[-1]
    assert len(shingles(known.of(""))) == 0 and len(shingles(known.of("a b"))) == 1 and len(shingles(known.of("a b c d e f"))) == 2


def test_components_against_union_find(spark):
    r = random.Random(3)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(300, 300), (None, 5)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
            up.setdefault(min(p, q), min(p, q))
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: top(n) for n in nodes}


def exact_classes(rows):
    """Plain Jaccard on five-word shingles, all pairs."""
    sets = [(d, frozenset(zip(*[(w := (t or "").lower().split())[i:] for i in range(5)], strict=False)) or frozenset([tuple((t or "").split())]), t) for d, t in rows]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if (sets[i][2] or "") == (sets[j][2] or "") or ((sets[i][2] or "").split() and len(a & b) >= 0.85 * len(a | b)):
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[top(i)].append(sets[i][0])
    return {frozenset(x for x in g if x is not None): None for g in groups.values()}


def test_near_duplicates_of_odd_rows(docs, nothing):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    classes = defaultdict(list)
    for r in rows:
        classes[r["class_id"]].append((r["doc_id"], r["kept"]))
    assert {x[0] for x in classes[1]} == {1, 2, 3, None} and all(k == (d == 1) for d, k in classes[1])
    assert {x[0] for x in classes[5]} == {5, 6}
    assert classes[None] == [(None, True)]
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 1, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14]
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.drop_near_duplicates(nothing).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rows = [(i, prose(100, i)) for i in range(60)] + [(100 + i, edited(prose(100, i), 90 + i)) for i in range(20)] + [(200 + i, prose(100, i % 7)) for i in range(30)]
    got = defaultdict(set)
    for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == set(exact_classes(rows))


def test_document_frequencies_are_those_of_shingles(spark):
    shared = prose(40, 60)
    rows = [(f"{i:016d}".encode(), 1 + i % 2, f"{shared if i % 3 else ''} {prose(9000, 700 + i)}") for i in range(150)]
    n = sum(r[1] for r in rows)
    sets = [np.unique(shingles(WordHashes().of(r[2]))) for r in rows]
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    assert len(ids) > 1 << 20
    df = np.bincount(at, np.repeat([r[1] for r in rows], [len(x) for x in sets]))
    level = np.round(8 * np.log((n + 1) / (df + 1)) / np.log(n + 1))
    rare = minhash.level_of(np.ones(1), n)[0]
    table = spark.createDataFrame(rows, "node binary, n long, text string").repartition(4)
    got = {bytes(r["node"]): r for r in minhash.common_shingles(table, n).collect()}
    for (node, _, _), own in zip(rows, sets, strict=True):
        found = dict(zip(got[node]["shingles"], got[node]["levels"], strict=True)) if node in got else {}
        want = level[np.searchsorted(ids, own)]
        assert [found.get(x, rare) for x in own.view(np.int64).tolist()] == want.tolist()


def test_weighted_sampling_agrees_with_weighted_jaccard():
    sampler, r = minhash.Sampler(4000, 1 << 10, 1), np.random.Generator(np.random.PCG64(2))
    ids = np.sort(r.integers(0, 2**63, 60, np.uint64))
    counts, levels = r.integers(1, 4, 60), r.integers(0, 9, 60).astype(np.uint8)
    a, b = slice(0, 45), slice(10, 60)
    same = (sampler.sample(ids[a], counts[a], levels[a]) == sampler.sample(ids[b], counts[b], levels[b])).mean()
    x, y = (minhash.elements(ids[s], counts[s], 1 + levels[s] / 8) for s in (a, b))
    assert abs(same - linking.jaccard(x, y)) < 0.05


def test_mixed_bucket_loses_no_link(spark):
    """One bucket for all: links that do not touch its head are found in cells of any size."""
    r = np.random.Generator(np.random.PCG64(4))
    base = [np.sort(r.integers(0, 2**60, 40, np.uint64)) for _ in range(12)]
    sets = {bytes([i, j]): np.sort(np.concatenate([base[i][: 40 - j], r.integers(0, 2**60, j, np.uint64)])) for i in range(12) for j in range(4)}
    nodes = spark.createDataFrame([(bytearray(n), [7]) for n in sets], "node binary, bands array<long>")
    data = spark.createDataFrame([(bytearray(n), bytearray(linking.pack(s))) for n, s in sets.items()], "node binary, data binary")
    for block in (5, 512):
        roots = linking.link_contents(nodes, lambda c: data.join(c, "node"), 0.8, False, block).collect()
        assert {bytes(x["node"]): bytes(x["root"])[0] for x in roots} == {n: n[0] for n in sets}


def test_bands_are_tuned():
    assert linking.tune_bands(0.8, 0.998) == (12, 4)
    with pytest.raises(ValueError):
        linking.tune_bands(0.05, 0.999, max_hashes=8)


def test_repeated_paragraphs_go_but_the_first(docs, nothing):
    rows = odd_documents()
    out = paragraphs.drop_repeated_paragraphs(docs)
    assert out.columns == [*[c for c in docs.columns if c != "n_removed"], "n_removed"]
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    text = {r[0]: r[1] for r in rows}
    assert got[7]["text"] == text[7] and got[7]["n_removed"] == 0
    assert got[8]["text"] == "two" and got[8]["n_removed"] == 2 and got[8]["n_chars"] == 3
    assert got[9]["text"] == "three"
    assert got[1]["text"] == text[1] and got[2]["text"] == "" and got[3]["text"] == ""
    assert got[5]["text"] is None and got[12]["text"] == text[12]
    assert out.count() == len(rows) and paragraphs.drop_repeated_paragraphs(nothing).count() == 0


def test_passages_go_wherever_their_lines_break(spark):
    p, q = prose(60, 31).split(), prose(51, 32).split()
    one, two, three, four, five = (prose(90, 40 + i) for i in range(5))
    broken = "\n".join(" ".join(p[i : i + 9]) for i in range(0, 60, 9))
    rows = [
        (1, f"{one} {' '.join(p)} {two}\n{' '.join(q)}"),
        (2, f"{three} {' '.join(p).upper()} {four}"),  # in mid-line
        (3, f"head\n{broken}\ntail"),  # over several short lines
        (4, f"{' '.join(p[5:40])}\n{' '.join(p[40:60])} {five}"),  # 55 of its words, across a break
        (5, f"{' '.join(q[:49])}\nother"),  # too short
        (6, f"{' '.join(q[:25])}\n{' '.join(q[25:])}"), (7, f"{' '.join(q[:25])}\n{' '.join(q[25:])}"),
        (8, "\n".join(["a line of words that is here again and again"] * 20)), (None, f"x {' '.join(p)}"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in paragraphs.drop_repeated_paragraphs(table).collect()}
    assert len(got) == len(rows)
    for i in (1, 5):
        assert (got[i]["text"], got[i]["n_removed"]) == (rows[i - 1][1], 0)
    assert (got[2]["text"], got[3]["text"], got[4]["text"], got[6]["text"], got[7]["text"], got[None]["text"]) == (
        f"{three} {four}", "head\ntail", five, "", "", "x",
    )
    assert got[8]["text"].split() == rows[7][1].split()[:50]


def test_passages_against_brute_force(spark):
    r, n = random.Random(77), 12
    parts = [prose(k, 500 + k).split() for k in (8, 11, 13, 20, 40)]
    rows = []
    for i in range(60):
        words = [w for _ in range(r.randrange(1, 6)) for w in (r.choice(parts)[r.randrange(6) :] if r.random() < 0.6 else prose(9, r.random()).split())]
        rows.append((i, "".join(w + r.choice(" \n\t") for w in words)))
    seen, want = {}, {}
    for i, text in rows:
        words = text.split()
        gone = set()
        for k in range(len(words) - n + 1):
            first = seen.setdefault(tuple(words[k : k + n]), (i, k))
            if first != (i, k):
                gone |= set(range(max(k, first[1] + n) if first[0] == i else k, k + n))
        want[i] = [w for k, w in enumerate(words) if k not in gone]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = {}
    for s in paragraphs.repeated_passages(table, n).collect():
        spans[s["text_key"].hex()] = s
    for i, text in rows:
        s = spans.get(hashlib.md5(text.encode()).hexdigest())
        got = text if s is None else paragraphs._cut(text, s["spans"]) if s["doc_id"] == i else ""
        assert got.split() == want[i]


def test_spans_are_joined_runs(spark):
    r = random.Random(8)
    runs = [(b"%d" % (i % 5), s, s + r.choice([1, 3, 12])) for i in range(60) for s in [r.randrange(90)]]
    found = {x["text_key"]: x["spans"] for x in paragraphs._spans(spark.createDataFrame(runs * 2, "text_key binary, start int, end int")).collect()}
    for key in {x[0] for x in runs}:
        words = {2 * w for k, s, e in runs if k == key for w in range(s, e)} | {2 * w - 1 for k, s, e in runs if k == key for w in range(s + 1, e + 1)}
        ends = [w for w in sorted(words) if w + 1 not in words]
        assert [e for _, e in found[key]] == [(w + 1) // 2 for w in ends]
        assert {w for s, e in found[key] for w in range(2 * s, 2 * e)} == words


def test_passages_are_found_without_gathering_runs_in_python(spark):
    """Runs of a text are not rows of Python lists, and texts without a passage do not go through Python to be cut."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    table = spark.createDataFrame([(i, prose(80, i % 2)) for i in range(4)], "doc_id long, text string")
    assert "EvalPython" not in plan(paragraphs.repeated_passages(table))
    cutting = plan(paragraphs.drop_repeated_paragraphs(table)).splitlines()
    union, cut = (next(i for i, x in enumerate(cutting) if part in x) for part in ("Union", "EvalPython [_cut("))
    assert union < cut


def test_kept_tables_go_through_python_in_small_batches(spark):
    """A task's texts are not in a worker all at once, and the session has its own settings again."""
    before = {key: spark.conf.get(key, None) for key in (common.BATCHES, common.FREE_SHUFFLES)}

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    kept = common.keep(spark.range(0, 4500, 1, 1).mapInArrow(sizes, "n long"), "sizes")
    found = [r["n"] for r in kept.collect()]
    assert sum(found) == 4500 and max(found) <= common.BATCH_ROWS
    assert {key: spark.conf.get(key, None) for key in before} == before


def test_workers_give_memory_back_after_each_task(monkeypatch):
    """Idle workers do not hold what their largest task took."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_key": [b"k"], "text": [prose(80, 1)], "chunk": [0], "n": [1], "toxic": [0]})
    for work in (paragraphs._anchors(50), paragraphs._sign(2, 4, 50, 8), toxicity._least_shingle, toxicity._patterns(None)):
        assert len(list(work(iter([batch])))) == 1
    assert len(minhash._blocks(1)(pa.Table.from_batches([batch]))) == 1
    assert len(calls) == 5


def test_free_memory_goes_back_to_the_system():
    process = psutil.Process()
    parts = [bytes(30_000) for _ in range(4000)]
    last, full = bytes(parts[-1]) + b"x", process.memory_info().rss
    del parts
    common.give_back()
    assert last and process.memory_info().rss < full - 80e6


def test_a_repeated_row_is_no_earlier_place(spark):
    """Rows that come twice repeat no passage; the same passage elsewhere does, once per place."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (1, passage), (2, f"other {passage} end"), (2, f"other {passage} end"), (3, prose(70, 3)), (3, prose(70, 3))]
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert [(r["doc_id"], r["spans"]) for r in found] == [(2, [[1, 61]])]


def test_windows_are_summed_with_one_place_each(spark):
    """The least place of a window and a number, not two places, are sorted and shuffled."""
    table = spark.createDataFrame([(i, prose(80, i % 2)) for i in range(4)], "doc_id long, text string")
    plan = paragraphs.repeated_passages(table)._jdf.queryExecution().optimizedPlan().toString()
    summed = next(x for x in plan.splitlines() if "Aggregate [window" in x)
    assert "min(" in summed and "max(" not in summed


def test_token_counts_are_the_librarys(docs, nothing, spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in tokencount.token_counts(docs, MODEL, limit=100).collect():
        assert r["over_limit"] == (r["n_tokens"] > 100)
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(docs, MODEL).collect())
    texts = [r[1] or "" for r in odd_documents()]
    assert got == sorted((len(t.encode()), len(model.encode(t))) for t in texts)
    assert tokencount.token_counts(nothing, MODEL).count() == 0
    machine, r = tokencount.Transducer(read_vocabulary(MODEL)), random.Random(9)
    parts = ["a", "b", " ", "  ", "\n", "the", "▁", "é", "日本", "\x00", "<s>", "ing", "    ", "🙂", "#", "\\", "on"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        for chunk in (1, 2, 5, 1 << 16):
            assert tokencount.count_tokens(text, machine, chunk) == len(model.encode(text)), text


def test_state_maps_compose_in_any_grouping():
    machine = tokencount.Transducer(read_vocabulary(MODEL))
    text = "▁the▁▁king▁of日▁▁▁spain▁"
    for i in range(len(text)):
        for j in range(i, len(text)):
            a, b, c = (tokencount.state_map(t, machine) for t in (text[:i], text[i:j], text[j:]))
            left = tokencount.compose(tokencount.compose(a, b, machine), c, machine)
            right = tokencount.compose(a, tokencount.compose(b, c, machine), machine)
            total = lambda m: machine.count(m.head) + (m.tokens or 0) + machine.count(m.tail)
            assert total(left) == total(right) == machine.count(text)


def test_viterbi_against_all_segmentations_and_round_trip(docs, nothing):
    vocabulary = read_vocabulary(MODEL)
    scores = pieces.log_scores(vocabulary)
    codec = pieces.Codec(vocabulary, scores, pieces.double_array([p for p, _, _ in vocabulary.pieces]))
    value = {p: s for (p, _, _), s in zip(vocabulary.pieces, scores, strict=True)}
    score_of = {i: s for (_, i, _), s in zip(vocabulary.pieces, scores, strict=True)}

    def best(word):
        if not word:
            return 0.0
        return max(best(word[k:]) + value.get(word[:k], codec.unknown if k == 1 else -math.inf) for k in range(1, len(word) + 1))

    for word in ("▁the", "▁thing", "ation", "▁▁▁▁a", "xqz", "é日🙂", "▁internat"):
        ids = codec.viterbi(word)
        raw = [i for i in ids if i not in score_of]
        got = sum(score_of[i] for i in ids if i in score_of) + codec.unknown * sum(c not in value for c in word)
        assert math.isclose(got, best(word)) and len(raw) == sum(len(c.encode()) for c in word if c not in value)
    rows = pieces.encode_documents(docs, MODEL)
    marker = {r["doc_id"] for r in rows.filter("not round_trip").collect()}
    assert marker == {13}  # it holds the marker itself
    back = pieces.decode_documents(rows, MODEL).filter("doc_id = 7").first()["text"]
    assert back == next(r[1] for r in odd_documents() if r[0] == 7)
    assert pieces.encode_documents(nothing, MODEL).count() == 0


def test_mixing_against_brute_force(docs, nothing, spark):
    weights = {("domain1",): 3.0, ("domain1", "en"): 2.0, ("domain2", "en", "src2"): 0.0}
    leaves = [("d1", "en", "a", 100), ("d1", "en", "b", 10), ("d1", "fr", "c", 30), ("d2", "en", "d", 1000)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(table, {("d1",): 3.0}, F.lit(200.0), 1).collect()}
    # d1 could have 150 but holds 140; en and fr share evenly, fr holds 30; b holds 10.
    assert got == pytest.approx({"a": 100, "b": 10, "c": 30, "d": 60})
    out = mixing.mix(docs, weights, total=700, max_epochs=2, seed=3)
    assert out.columns == [*[c for c in docs.columns if c != "epoch"], "epoch", "n_tokens"]
    rows = out.collect()
    taken = defaultdict(int)
    for r in rows:
        taken[r["lang"], r["source"]] += r["n_tokens"]
    assert sum(taken.values()) <= 700 and taken["en", "src2"] == 0
    hundred = [(i, prose(10, i), "en", "src1") for i in range(100)]
    one = mixing.mix(spark.createDataFrame(hundred, "doc_id long, text string, lang string, source string"), total=1337, max_epochs=3).collect()
    assert sum(r["n_tokens"] for r in one) == 1330  # 1 epoch of 1000, then the longest prefix
    assert {r["doc_id"] for r in one if r["epoch"] == 1} == set(range(100)) and sum(r["epoch"] == 2 for r in one) == 33
    assert mixing.mix(nothing).count() == 0


def test_mixing_spends_what_a_weight_of_zero_leaves(spark):
    leaves = [("A", "en", "x", 1000), ("A", "fr", "y", 100), ("A", "fr", "v", 50), ("B", "en", "z", 1000)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {("A", "en"): 0.0, ("A", "fr", "v"): 0.0}
    got = {r["source"]: r["budget"] for r in mixing.budgets(table, weights, F.lit(600.0), 1).collect()}
    assert got == pytest.approx({"x": 0, "v": 0, "y": 100, "z": 500})


def test_toxicity_learns_patterns_and_reads_clauses(spark, docs, nothing):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = prose(60, i).split()
        for _ in range(3 * toxic):
            words.insert(r.randrange(60), "grob" + r.choice(["ian", "heit", "sch", "ling", "us"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(table, spark.createDataFrame([*labels, (None, 1), (3, None), (3, 0)], "doc_id long, toxic int"))
    assert any("grobian".startswith(s) for s in model.starts)
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(table, model).collect()}
    assert np.mean([scored[i] == t for i, t in labels]) > 0.97
    grammar = toxicity.Grammar(toxicity.Model({"idiot": 3.0}, {}, toxicity.UNTRAINED))
    assert dict(grammar.clause("you idiot")) == {"targeted": 3.0} and dict(grammar.clause("idiot, he")) == {"targeted": 3.0}
    assert dict(grammar.clause("not an idiot")) == {"negated": 3.0} and dict(grammar.clause("said idiot")) == {"reported": 3.0}
    assert dict(grammar.clause("the idiot")) == {"plain": 3.0}
    untrained = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(docs, untrained)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count() and got[14]["predicted"] == 1 and got[5]["score"] == got[6]["score"] < 0.5
    assert 14 not in {r["doc_id"] for r in toxicity.drop_toxic(docs, untrained).collect()}
    assert toxicity.score_toxicity(nothing, untrained).count() == 0


def test_clauses_of_any_length_are_read_as_one():
    grammar = toxicity.Grammar(toxicity.Model({"idiot": 3.0}, {}, toxicity.UNTRAINED))
    at = {f: i for i, f in enumerate(toxicity.FEATURES)}
    far = "word " * 900
    x = grammar.features(f"fine. idiot {far} idiot {far} you. idiot")
    assert x[at["targeted"]] == pytest.approx(math.log1p(6)) and x[at["plain"]] == pytest.approx(math.log1p(3))
    assert x[at["clauses"]] == pytest.approx(math.log1p(2))
    x = grammar.features(f"said idiot {far} idiot")
    assert x[at["reported"]] == pytest.approx(math.log1p(6)) and x[at["plain"]] == 0
    x = grammar.features("idiot".ljust(1999, "x") + "y " + "a" * 1990 + " idiot")
    assert x[at["clauses"]] == pytest.approx(math.log1p(1))


VECTORS = "vec_id long, embedding array<float>, label int, v string, ids string, q string"


def odd_vectors():
    r = random.Random(5)
    base = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, v, i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, [x + r.uniform(-0.02, 0.02) for x in base[i % 8]], (i % 8) % 3) for i in range(40)]
    rows += [(150, base[0], 0), (150, base[0], 0), (151, base[0], None), (152, None, 0), (153, [float("nan")] * 8, 0), (154, [0.0] * 8, 0), (155, [None] + base[0][1:], 0), (156, [1.0, 2.0], 0), (157, [2.0, 4.0], 0), (None, base[1], 1), (158, [], 0), (159, [math.inf] * 8, 1)]
    return [(*x, "v", "i", "q") for x in rows]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_against_brute_force(spark, monkeypatch):
    table = spark.createDataFrame(odd_vectors(), VECTORS).repartition(3)
    rows = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], np.float64)).astype(int)) for r in table.collect() if r["vec_id"] is not None and usable(r["embedding"])]
    expected = set()
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        found = [(-int(v @ w), j) for i, v in rows if i == q for j, w in rows if j != q and len(v) == len(w)]
        expected |= {(q, n, j, -s) for n, (s, j) in enumerate(sorted(found)[:5], 1)}
    for limit in (topk.BROADCAST_BYTES, 0):
        monkeypatch.setattr(topk, "BROADCAST_BYTES", limit)
        got = {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, tile=16).collect()}
        assert got == expected
    assert topk.top_k(table.filter("false"), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(0, [2.0e6, 1.0]), (1, [2.0e6, 2.0]), (2, [9e30, 1.0])], "vec_id long, embedding array<double>")
    got = [r["score"] for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [2**63 - 1, (256 * 2_000_000) ** 2 + 256 * 512]


def test_linked_vectors_against_brute_force(spark):
    table = spark.createDataFrame(odd_vectors(), VECTORS).repartition(3)
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64) if usable(r["embedding"]) and any(r["embedding"]) else None, r["label"]) for r in table.collect()]
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if i != j and v is not None and w is not None and a is not None and a == b and len(v) == len(w):
                near[i][j] = v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            comp[i] = min([comp[i], *(comp[j] for j in range(n) if near[i][j])])
    least = {c: min((rows[i][0] for i in range(n) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    expected = sorted((str(rows[i][0]), sum(near[i]), str(least[comp[i]]), rows[i][0] == least[comp[i]]) for i in range(n))
    for block in (4, 1024):
        got = multiindex.linked_vectors(table, block=block).collect()
        assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == expected
    assert multiindex.linked_vectors(table.filter("false")).count() == 0


def test_index_reaches_its_recall(spark):
    """Pairs at the largest linked distance, in random directions, by cells alone."""
    r = np.random.Generator(np.random.PCG64(1))
    x = multiindex.unit(r.normal(size=(2000, 64)))
    noise = multiindex.unit(r.normal(size=(2000, 64)))
    y = multiindex.unit(x + 0.2 * noise)
    index = multiindex.Index(multiindex.k_means(x[:, :32], 12), multiindex.k_means(x[:, 32:], 12))
    reach = 3.719 / 8 * 0.2
    a, b = [index.cells(v, reach) for v in x], [index.cells(v, reach) for v in y]
    recall = np.mean([q[0] in p or p[0] in q for p, q in zip(a, b, strict=True)])
    visited = np.mean([len(p) for p in a])
    assert recall >= 0.99 and visited < 144


def test_chat_round_trip_and_rewriting_templates(spark):
    text = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "assistant", None), (2, None, None, "a"), (2, 0, "as>\\<#", "\\"), (None, 0, "user", ""), (2, 0, "as>\\<#", "\\"), (3, 0, "assistant", "</turn>\n" * 9)]
    table = spark.createDataFrame([(*r, "f", "m") for r in rows], "conv_id long, turn long, role string, text string, formatted string, mask string")
    formatted = chat.format_conversations(table)
    assert not formatted.filter("rewrites").count()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by_conv = defaultdict(list)
    for c, n, r, t in rows:
        by_conv[c].append((-1 if n is None else n, r or "", t or ""))
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    for conv, turns in by_conv.items():
        turns = sorted(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in turns)) and got[conv]["n_turns"] == len(turns)
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.format_conversations(table.filter("false")).count() == 0

    def forgetful(messages):  # shows only the last answer
        return "".join(f"{r}: {t if r == 'user' or i == len(messages) - 1 else '...'}\n" for i, (r, t) in enumerate(messages))

    out, spans, rewrites = chat.locate([("user", "q"), ("assistant", "a"), ("user", "q2")], forgetful)
    assert rewrites and spans == [None, None, None] and out.startswith("user: q")


def test_archives_round_trip(spark, monkeypatch):
    pages = [(1, "http://a", "x"), (2, "http://b\r\n%0D", "x"), (3, None, None), (4, "u", ""), (None, "u", "x"), (5, "é", "日" * 100_000), (2, "again", "y"), (2, "again", "y"), (6, "s", "y")]
    table = spark.createDataFrame([(*p, "k", 1, "s") for p in pages], "page_id long, url string, html string, kind string, offset long, sha string").repartition(2)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    expected = sorted(
        (str(i), len((h or "").encode()), sha((h or "").encode()), "response" if i == first[h or ""] else "revisit", str(None if i == first[h or ""] else first[h or ""]))
        for i, _, h in pages
    )
    got = sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in warc.page_digests(table).collect())
    assert got == expected
    index, folder = warc.archive(table, min_bytes=2)
    assert index.filter("kind = 'revisit'").count() == 0
    back = warc.read_archives(index.filter("page_id = 2"), folder).collect()
    assert sorted((r["url"], bytes(r["payload"])) for r in back) == [("again", b"y"), ("again", b"y"), ("http://b\r\n%0D", b"x")]
    assert warc.page_digests(table.filter("false")).count() == 0


def test_pipeline_stages_on_odd_rows(spark, docs, nothing, tmp_path):
    spark.createDataFrame([(i, 0, 0) for i in range(1, 14)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, nothing):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "encoding":
                assert now.columns == list(corpus_pipeline.COLUMNS)
        assert now.columns[:2] == ["doc_id", "ids"]
        ids = {r["doc_id"] for r in now.collect()}
        assert 2 not in ids and 14 not in ids


def kept_names(spark):
    """Kept tables that lie in the shared folder."""
    folder = common.shared_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("llm-")}


def test_kept_tables_go_when_all_that_reads_them_is_kept(spark, docs):
    """Only what the unfinished result still reads stays in the shared folder."""
    kinds = lambda names: sorted(n.split("-")[1] for n in names)
    text = docs.select("doc_id", "text")
    for made, left in (
        (lambda: minhash.near_duplicates(text), ["classes", "levels"]),
        (lambda: paragraphs.drop_repeated_paragraphs(text), ["shortened", "spans"]),
        (lambda: mixing.mix(docs, fraction=0.9, max_epochs=1), ["plan"]),
    ):
        before = kept_names(spark)
        result = made()
        assert kinds(kept_names(spark) - before) == left
        assert result.count() >= 0


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    """A round is seven shuffles; a table of one task's work needs none, a larger one has the same components."""
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 99) for i in range(30)] + [(7, 7), (None, 1)]
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    expected = {i: 0 for i in range(41)} | {i: 99 for i in range(99, 130)}
    rounds = []
    module = sys.modules["fleetlens.llm.components"]
    real = module._print
    monkeypatch.setattr(module, "_print", lambda edges: rounds.append(1) or real(edges))
    assert {r["node"]: r["root"] for r in components(table).collect()} == expected and not rounds
    monkeypatch.setattr(module, "PART", 20)
    before = kept_names(spark)
    roots = components(table)
    assert len(kept_names(spark) - before) == 1
    assert {r["node"]: r["root"] for r in roots.collect()} == expected and rounds
