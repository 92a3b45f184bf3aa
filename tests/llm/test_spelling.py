import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import spelling


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = counted(rows)
    near = {w: [] for w in n}
    by_len = {}
    for w in n:
        by_len.setdefault(len(w), []).append(w)
    for w in n:
        for m in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [v for v in by_len.get(m, ()) if one_edit(w, v)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def run(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect())


def test_odd_rows(odd, odd_rows):
    assert run(odd) == brute([(r[0], r[1]) for r in odd_rows])


def test_empty_table(none):
    assert run(none) == []


def typo(w, rng):
    i, c = int(rng.integers(0, len(w) + 1)), str(rng.choice(list("abcé×")))
    return [w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]][int(rng.integers(0, 3))]


@pytest.mark.parametrize("index_words", [5, 50_000])
def test_typos_of_typos(spark, monkeypatch, index_words):
    """Words over few letters with typos of typos, so that words are near at every place; also in tiny indexes,
    where every half is hot and cut into pieces."""
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abé"), int(rng.integers(6, 12)))) for _ in range(60)]
    texts = []
    for w in base:
        t = typo(w, rng)
        texts += [w] * int(rng.integers(2, 300)) + [t] * int(rng.integers(1, 30)) + [typo(t, rng)] * 2 + [typo(w, rng).upper()] * 2
    rng.shuffle(texts)
    rows = [(int(i) if i % 9 else None, " ".join(texts[i : i + 40])) for i in range(0, len(texts), 40)]
    monkeypatch.setattr(spelling, "INDEX_WORDS", index_words)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == brute(rows)


def test_index_finds_all_pairs_once():
    rng = np.random.default_rng(11)
    words = sorted({"".join(rng.choice(list("ab"), int(rng.integers(7, 11)))) for _ in range(300)})
    yes = np.ones(len(words), bool)
    found = [(int(i), int(j)) for left in (True, False) for one, two in spelling.near_words(words, yes, yes, left) for i, j in zip(one, two)]
    assert sorted(found) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)]


def test_very_long_words():
    words = ["x" * 5000, "x" * 4999, "x" * 4000 + "y" + "x" * 999, "y" * 30]
    yes = np.ones(len(words), bool)
    found = {(int(i), int(j)) for left in (True, False) for one, two in spelling.near_words(words, yes, yes, left) for i, j in zip(one, two)}
    assert found == {(0, 1), (1, 0), (0, 2), (2, 0)} | {(1, 2), (2, 1)}


def test_chain_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w10")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w11" for w, _ in forms}
