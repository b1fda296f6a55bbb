import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import queries, spelling


def brute_words(rows):
    upper = {ord("A") + i: ord("a") + i for i in range(26)}
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(counts, ratio=2):
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    around = {w: [v for m in (-1, 0, 1) for v in by_length[len(w) + m] if near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(around[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(around[w]), counts.get(form[w])) for w, n in counts.items()}


def misspelt(word, rng):
    i = rng.randrange(len(word))
    letter = rng.choice(spelling.ALPHABET)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]])


def counted(spark, counts):
    return spark.createDataFrame([(w, n, 1, "x") for w, n in counts], "word string, n long, id int, key string")


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("bits, most", [(24, 4 << 20), (24, 7), (2, 4 << 20)])
def test_groups_equal_brute_force(spark, bits, most):
    """Also where the filter is probed in many ranges, and where it is so full that most edits are false positives."""
    rng = random.Random(bits + most)
    counts = {}
    for i in range(60):
        word = "".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 9)))
        counts[word] = rng.choice([3, 50, 400, 400])
        for _ in range(rng.randrange(6)):
            word = misspelt(word, rng)
            if len(word) >= 5:
                counts.setdefault(word, rng.choice([3, 6, 12, 24, 100]))
    counts |= {"z" * 3000: 9, "z" * 2999: 20, "z" * 1500 + "y" + "z" * 1499: 4, "aab" * 30: 3, "aab" * 29 + "aac": 6}
    got = spelling.group_variants(counted(spark, counts.items()), bits=bits, most=most)
    assert rows_of(got) == brute_groups(counts)


def test_chains_ties_and_odd_rows(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "ccccc": 5, "ccccd": 10, "cccce": 10, "lonely": 3}
    rows = [*counts.items(), (None, 4), ("", 7)]
    rows = [("lonely", 1) if r[0] == "lonely" else r for r in rows] + [("lonely", 2)]  # repeated words count together
    got = rows_of(spelling.group_variants(counted(spark, rows)))
    assert got == brute_groups(counts)
    assert ("aaaaa", "aaaab", "bbbbb", 1, 1, 2) in got and ("ccccc", "ccccd", "ccccd", 5, 2, 10) in got
    assert spelling.group_variants(counted(spark, [])).collect() == []
    with pytest.raises(Exception, match="alphabet"):
        spelling.group_variants(counted(spark, [("привет", 3)])).collect()
    with pytest.raises(ValueError):
        spelling.group_variants(counted(spark, []), ratio=1)


def test_every_edit_once():
    for word in ("aab", "abcé", "zzzz", "a", "ÿaÀ"):
        alphabet = np.array(sorted(map(ord, spelling.ALPHABET)), dtype="<u4")
        keys = [int(k) for w, length, key in spelling.Letters([word, "other"], alphabet).edits() for k in key[w == 0]]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))}
        want |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in spelling.ALPHABET if c > word[i]}
        assert sorted(keys) == sorted(int(k) for k in spelling.Letters(sorted(want), alphabet).keys())


def test_query(spark, tmp_path):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeÀéñ") for _ in range(rng.randrange(3, 12))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice("  -,.1") + rng.choice([str.upper, str.title, str])(rng.choice(stems)) for _ in range(400))) for i in range(40)]
    rows += [(None, "stray words here " * 5), (90, None), (91, ""), (92, "× ÷÷÷÷÷ ÀÀÀÀÀ Straße ﬁnger"), (93, "long" * 40000), (94, rows[0][1]), (94, rows[0][1])]
    spark.createDataFrame([(d, t, "w", 3) for d, t in rows], "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert rows_of(got) == brute_groups(brute_words(rows)) and got.filter("form IS NOT NULL").count() > 0
