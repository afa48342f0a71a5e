"""Decontamination, ranked search and spelling variants on odd rows and against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import connect, difference
from fleetlens.llm import decontaminate, queries, ranking, spelling
from fleetlens.llm.common import LONG_WORD, word_spans, words_of
from tests.conftest import SF

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_ranked_search", "op13_spelling"])
def test_query_matches_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


@given(st.text(alphabet="aZ9é日 \x85　_-\n\x00🙂`{", max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_and_their_places(text):
    words = plain_words(text)
    assert [w.decode() for w in words_of(text)] == words
    starts, ends = word_spans(text)
    assert [text[a:b].translate(LOWER) for a, b in zip(starts, ends, strict=True)] == words


def test_long_words_take_bounded_room():
    a, b = words_of("x" * 10_000 + " " + "x" * 10_001)
    assert a != b and max(len(a), len(b)) < LONG_WORD and a == words_of("X" * 10_000)[0]


def vocabulary(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abdeéßk日") for _ in range(r.randint(1, 6))) for _ in range(n)]


def sentences(n, length, seed, words):
    r = random.Random(seed)
    return [r.choice([" ", "\n", ", ", "--"]).join(r.choice(words) for _ in range(r.randint(0, length))) for _ in range(n)]


DOCUMENTS = "doc_id long, text string, n_words long, items string, spans string, score string, rank string, item string"
ITEMS = "item_id string, text string, doc_id long, n long, term string"


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "i", "s", "c", "r", "m") for i, t in docs], DOCUMENTS).repartition(3),
        spark.createDataFrame([(i, t, 1, 2, "t") for i, t in items], ITEMS).repartition(2),
    )


def found_by_hand(docs, items, window):
    out = []
    for doc_id, text in docs:
        words, hit, named = plain_words(text), set(), set()
        for item, body in items:
            own = plain_words(body)
            k = min(window, len(own))
            for i in range(len(own) - k + 1 if k else 0):
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == own[i : i + k]:
                        hit |= set(range(j, j + k))
                        named.add(item)
        out.append((doc_id, len(words), len(hit), tuple(sorted(named - {None}))))
    return Counter(out)


def leaked():
    words = vocabulary(30, 1)
    items = [(f"i{n}", t) for n, t in enumerate(sentences(25, 40, 2, words))]
    docs = [(n, t) for n, t in enumerate(sentences(60, 50, 3, words))]
    docs += [(100 + n, f"{d} | {t.upper()} ... {d}") for n, ((_, t), (_, d)) in enumerate(zip(items, docs, strict=False))]
    long = " ".join(vocabulary(20_000, 9))
    docs += [(200, None), (201, ""), (202, " .,- "), (None, items[3][1]), (5, docs[5][1]), (5, docs[5][1]), (203, f"{long} {items[4][1]}")]
    items += [("i1", items[2][1]), ("i1", items[2][1]), (None, docs[7][1]), ("empty", ""), ("null", None), ("one", words[0]), ("Z", items[4][1])]
    return docs, items


@pytest.mark.parametrize("block", [1 << 17, 60])
def test_contamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 16 if block == 60 else 4096)
    docs, items = leaked()
    d, i = tables(spark, docs, items)
    rows = decontaminate.find_items(d, i, window=4, block_words=block).collect()
    expected = found_by_hand(docs, items, 4)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows) == expected
    texts = defaultdict(set)
    for doc_id, text in docs:
        texts[doc_id].add(text)
    for r in rows:
        for text in texts[r["doc_id"]] if len(texts[r["doc_id"]]) == 1 else ():
            assert sum(len(plain_words(text[s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]
    clean = decontaminate.drop_contaminated(d, i, window=4, block_words=block)
    assert clean.columns == d.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(x[0] for x in expected.elements() if not x[2])


def test_contamination_of_empty_tables(spark):
    docs, items = tables(spark, *leaked())
    assert decontaminate.contamination(docs.filter("false"), items).count() == 0
    none = decontaminate.contamination(docs, items.filter("false")).collect()
    assert len(none) == docs.count() and not any(r["contaminated"] or r["n_items"] for r in none)
    assert {r["items_sha256"] for r in none} == {hashlib.sha256(b"").hexdigest()}
    assert decontaminate.drop_contaminated(docs, items.filter("text is null")).count() == docs.count()


def ranked_by_hand(docs, items, k):
    counted = [(i, Counter(plain_words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(Counter)
    for item, text in {(i, t) for i, t in items if i is not None}:
        wanted[item].update(plain_words(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc_id, c in counted:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in terms.items() if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [1 << 18, 12])
def test_ranking_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "DOCUMENTS", 7)
    docs, items = leaked()
    d, i = tables(spark, docs, items)
    rows = ranking.rank_documents(d, i, k=6, block_postings=block).collect()
    assert Counter(map(tuple, rows)) == ranked_by_hand(docs, items, 6)


def test_ranking_keeps_ties_in_order_and_the_type_of_ids(spark):
    docs, items = tables(spark, [(n % 40, "same words here") for n in range(120)] + [(None, "same words here")], [("7", "words")])
    rows = ranking.rank_documents(docs, items.selectExpr("cast(item_id as int) as item_id", "text"), k=5).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [(7, 1, 0), (7, 2, 0), (7, 3, 0), (7, 4, 1), (7, 5, 1)]
    assert ranking.rank_documents(docs.filter("false"), items).count() == 0
    assert ranking.rank_documents(docs, items.filter("false")).count() == 0
    assert ranking.rank_documents(docs.withColumn("text", docs.text.substr(0, 0)), items).count() == 0


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


@given(st.lists(st.text(alphabet="abé", max_size=6), unique=True, max_size=30), st.text(alphabet="abé", max_size=6), st.integers(0, 2))
@settings(max_examples=400, deadline=None)
def test_sorted_scan_finds_one_edit(words, word, prefix):
    words = sorted(words)
    listed = spelling.SortedList(words)
    start = next((i for i, w in enumerate(words) if len(w) >= prefix and w[:prefix] == word[:prefix]), len(words))
    if len(word) >= prefix:
        found = [words[i] for i in listed.near(word, start, prefix)]
        assert found == [w for w in words if w[:prefix] == word[:prefix] and one_edit(w, word)]


def variants_by_hand(counts, ratio):
    near = {w: sorted(((-counts[x], x) for x in counts if one_edit(w, x))) for w in counts}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= ratio * counts[w] else None for w in counts}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


@pytest.mark.parametrize("block", [2048, 5])
def test_variants_against_brute_force(spark, block):
    r = random.Random(4)
    stems = ["".join(r.choice("abcé") for _ in range(r.randint(7, 9))) for _ in range(40)]
    counts = {}
    for i, stem in enumerate(["common" + s for s in stems[:15]] + stems):  # a prefix that many share
        counts[stem] = 10 ** r.randint(0, 4) + i
        for _ in range(5):
            p, c = r.randrange(len(stem)), r.choice("abcéx")
            counts.setdefault(r.choice([stem[:p] + c + stem[p + 1 :], stem[:p] + c + stem[p:], stem[:p] + stem[p + 1 :]]), r.choice([2, 2, 30, 200]))
    counts = {w: n for w, n in counts.items() if len(w) >= 7}
    words = spark.createDataFrame([(w, n, "f", 1) for w, n in counts.items()] + [(None, 3, "f", 1)], "word string, n long, form string, n_near long")
    rows = spelling.variants(words, block=block).collect()
    assert len(rows) == len(counts) and set(map(tuple, rows)) == variants_by_hand(counts, 10)
    assert spelling.variants(words.filter("false")).count() == 0


def test_short_words_have_variants_too(spark):
    counts = {w: 10**n for n, w in enumerate(["a", "b", "ab", "abc", "xbc", "c"])}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert set(map(tuple, spelling.variants(words, min_length=1, block=2).collect())) == variants_by_hand(counts, 10)
    with pytest.raises(ValueError):
        spelling.variants(words, ratio=1)


def counted_by_hand(docs, every):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("every", [None, 3])
def test_counting_against_brute_force(spark, monkeypatch, every):
    monkeypatch.setattr(spelling, "HELD", 20)
    words = ["Größe", "Überraschung", "seventy-seven", "señorÍta×÷", "ÀÉîõüÿÀ", "Łódźwords", "straßenbahn", "日wordsand日", "x" * 3000, "shortst"]
    r = random.Random(2)
    docs = [(n if n % 5 else None, r.choice(" \n9_").join(r.choice(words) for _ in range(30))) for n in range(40)]
    docs += [(1, None), (2, ""), (3, docs[3][1]), (3, docs[3][1])]
    table, _ = tables(spark, docs, [("a", "b")])
    assert {r["word"]: r["n"] for r in spelling.count_words(table, drop_every=every).collect()} == counted_by_hand(docs, every)
    assert spelling.count_words(table.filter("false")).count() == 0


def test_spelling_workers_give_memory_back(spark, monkeypatch):
    """Workers of every step, idle ones as well, do not hold what their largest task took."""
    real, wrapped = spelling.tidy, []
    monkeypatch.setattr(spelling, "tidy", lambda work: wrapped.append(work.__name__) or real(work))
    table = spark.createDataFrame([(1, "mistaken mistaken mistakem mistakem")], "doc_id long, text string")
    assert spelling.variants(spelling.count_words(table)).count() == 2
    assert set(wrapped) == {"count", "pack", "partners", "scan"}
