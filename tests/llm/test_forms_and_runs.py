"""Fill-in-the-middle forms and periodic runs against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenvec.llm import fill_in_middle as fim
from lumenvec.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, output string, form string"
ODD = [(None, None), (7000, ""), (7003, " \n"), (None, "a b c"), (7004, "é ü\tñ\x0b x" * 100), (7005, "x y"), (7006, "漢字 " * 50), (7007, "a<P>b"), (7008, "<M"), (7009, "<<S>"), (7010, "\U0001f600 b <S <"), (7005, "x y"), (7005, "another text")]


def docs_of(spark, rows, parts=3):
    """With two columns that clash with names inside the operators."""
    return spark.createDataFrame([(i, t, "o", "f") for i, t in rows], DOCS).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill in the middle


def plain_form(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    if not t or any(s in t for s in fim.SENTINELS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, a, b - a, sha(out), sha(t)


def test_fill_in_middle(spark):
    random.seed(5)
    rows = ODD + [(i, "".join(random.choice("ab <>PSM\né") for _ in range(random.randrange(60)))) for i in range(400)] + [(9000, "word é\n" * 300_000)]
    got = fim.fim_table(docs_of(spark, rows)).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(plain_form(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    words = {(i, len(t or ""), len(WORD.findall(t or ""))) for i, t in rows}
    assert {(r.doc_id, r.n, r.n_words) for r in got} == words
    assert fim.fim_table(docs_of(spark, rows).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t<é", max_size=40), st.sampled_from(["chars", "words", "lines"]))
def test_ranks_of_units(text, units):
    """Ranks from events against units counted one by one."""
    starts = {"chars": list(range(len(text))), "words": [m.start() for m in WORD.finditer(text)], "lines": [m.start() for m in re.finditer(r"[^\n]*\n|[^\n]+$", text)]}[units]
    e = fim.Events(text, fim.SENTINELS, fim.CLASS_CHANGES[units])
    assert e.count(units) == len(starts)
    assert e.offsets(units, range(len(starts) + 1)) == [*starts, len(text)]
    assert e.begun(units, range(len(text) + 1)) == [sum(s < o for s in starts) for o in range(len(text) + 1)]


@pytest.mark.parametrize("units", ["words", "lines"])
def test_other_units_and_sentinels(spark, units):
    rows = [(i, f"one two {i}\n  three\t\n four five\n" * (i % 5)) for i in range(60)]
    marks = ("[pre]", "[suf]", "[mid]")
    forms = fim.fill_in_middle(docs_of(spark, rows), units=units, sentinels=marks, seed="x", rate=100, spm=50)
    got = fim.restore(forms, marks).collect()
    assert Counter((r.doc_id, r.restored) for r in got) == Counter(rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:  # parts begin where units begin
        text = dict(rows)[r.doc_id]
        if r.form != "plain":
            for at in (r.prefix_chars, r.prefix_chars + r.middle_chars):
                assert at in (0, len(text)) or (text[at - 1] == "\n" if units == "lines" else not text[at].isspace() and text[at - 1].isspace())
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("a", "xay", "c"), ("", "b", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fim.checked(bad)


# Periodic runs


def smallest_period(w):
    """By the border array, as textbooks have it."""
    border = [0] * len(w)
    for i in range(1, len(w)):
        k = border[i - 1]
        while k and w[i] != w[k]:
            k = border[k - 1]
        border[i] = k + (w[i] == w[k])
    return len(w) - border[-1] if w else 0


def brute_runs(w, min_words=24, copies=3):
    """Every stretch of every period, word by word; kept if the period is its smallest."""
    out = []
    for p in range(1, len(w) // copies + 1):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            b = i
            while b < len(w) - p and w[b] == w[b + p]:
                b += 1
            length = b + p - i
            if length >= max(min_words, copies * p) and smallest_period(w[i : b + p]) == p:
                out.append((i, p, length))
            i = b
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=90), st.integers(1, 6), st.integers(1, 40), st.integers(1, 40), st.integers(3, 4), st.integers(1, 24))
def test_runs_of_small_alphabets(w, times, i, j, copies, min_words):
    w = w[:i] * times + w[j:] + w[:j] * 3
    got = [(r.start, r.period, r.length) for r in pr.find_runs(np.array(w, np.int64), min_words, copies)]
    assert got == brute_runs(w, min_words, copies)


def test_runs_in_long_sequences():
    rng = np.random.default_rng(2)
    for n, alphabet in ((3000, 2), (3000, 4), (2500, 3000)):
        w = rng.integers(0, alphabet, n)
        for _ in range(12):
            at, p = int(rng.integers(0, n - 300)), int(rng.integers(1, 70))
            w[at : at + 300] = w[at + np.arange(300) % p]
        assert [(r.start, r.period, r.length) for r in pr.find_runs(w)] == brute_runs(w.tolist())
    n = 400_000  # one word over and over, and one long period: no work that grows with the square
    assert pr.find_runs(np.zeros(n, np.int64)) == [pr.Run(0, 1, n)]
    w = np.tile(rng.permutation(n // 4), 4)
    assert pr.find_runs(w) == [pr.Run(0, n // 4, n)]
    with pytest.raises(ValueError):
        pr.find_runs(w, copies=2)


def planted_words(doc_id, words):
    h, n = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def plain_runs(doc_id, text):
    words = planted_words(doc_id, WORD.findall(text or ""))
    runs = [(s, length, p) for s, p, length in brute_runs(words)]
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(kept)


def test_periodic_runs(spark):
    random.seed(9)
    word = lambda: random.choice(["a", "bé", "c", "漢"])
    rows = ODD + [(i, " ".join([word() for _ in range(random.randrange(40))] + [word() for _ in range(random.randrange(1, 9))] * random.randrange(30))) for i in range(300)]
    rows += [(i, " ".join(f"w{random.randrange(300)}" for _ in range(random.randrange(400)))) for i in range(300, 700)]
    got = pr.runs_table(docs_of(spark, rows)).collect()
    assert Counter(tuple(r)[:8] for r in got) == Counter(plain_runs(*r) for r in rows)
    assert {r.n_words for r in got if r.doc_id is None} == {0, 3} and any(r.n_runs > 1 for r in got)
    assert pr.runs_table(docs_of(spark, rows).limit(0)).count() == 0


def test_runs_of_very_long_texts(spark):
    rows = [(1, "tick tock " * 500_000), (2, "x" * 8_000_000 + " y" * 30), (3, "漢" * 3_000_000)]
    got = {r.doc_id: r for r in pr.periodic_runs(docs_of(spark, rows)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 1_000_000, 2)] and got[1].n_dropped == 999_998 and got[1].collapsed_sha256 == sha("tick tock")
    assert [tuple(x) for x in got[2].runs] == [(1, 30, 1)] and got[2].collapsed_sha256 == sha("x" * 8_000_000 + " y")
    assert not got[3].runs and got[3].collapsed_sha256 == sha(rows[2][1])


def test_equal_hashes_of_different_words_make_no_run(spark, monkeypatch):
    words = pr.words_in(__import__("pyarrow").array([" ".join(f"w{i}" for i in range(60)) + " z" * 40]))
    text = pr._Text(words, np.arange(100))
    assert not text.same(pr.Run(0, 1, 60)) and text.same(pr.Run(60, 1, 40))
    assert pr.find_runs(text.numbers()) == [pr.Run(60, 1, 40)]
