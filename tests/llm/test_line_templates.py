import numpy as np
from llm.test_operators import docs, prose

from factloom.llm import line_templates, near_dups


def left(spark, rows):
    """The lines each document keeps."""
    got = line_templates.drop_recurring_lines(docs(spark, rows)).collect()
    return {r.doc_id: r.text.split("\n") for r in got}


def letters(n, seed):
    return "".join(chr(ord("a") + int(c)) if c.isdigit() else c for c in prose(n, seed, 10**6))


def test_a_long_passage_of_unlike_short_documents_goes(spark):
    passage = letters(60, 1)
    rows = [(i, f"{letters(15, 100 + i)}\n{passage}\n{letters(15, 300 + i)}") for i in range(50)]
    got = left(spark, rows)
    assert all(passage not in got[i] and len(got[i]) == 2 for i in range(50))


def test_copies_shield_no_line_for_other_documents(spark):
    passage, copy = letters(12, 2), "\n".join(letters(12, 10 + k) for k in range(6))
    rows = [(i, f"{copy}\n{passage}") for i in range(40)]
    rows += [(100 + i, f"{letters(40, 500 + i)}\n{passage}") for i in range(20)]
    got = left(spark, rows)
    assert all(passage not in x for x in got.values())
    assert all(got[i] == copy.split("\n") for i in range(40))  # what only copies share stays


def test_edited_copies_count_as_one_document(spark):
    copy = [letters(12, 30 + k) for k in range(20)]
    rows = []
    for i in range(40):
        line = copy[5].split(" ")
        line[6] = letters(1, 900 + i)
        rows.append((i, "\n".join([*copy[:5], " ".join(line), *copy[6:]])))
    lead = " ".join(copy[5].split(" ")[:3])
    rows += [(100 + i, f"{letters(40, 700 + i)}\n{lead} {letters(9, 800 + i)}") for i in range(10)]
    got = left(spark, rows)
    assert all(got[d] == text.split("\n") for d, text in rows)


def test_short_lines_and_long_lines_of_few_documents(spark):
    once, twice, thrice = letters(12, 40), letters(55, 41), letters(25, 42)
    notes = ["All rights reserved.", "Chapter 5", "END", "Released under the MIT License."]
    rows = [(i, "\n".join([letters(40, 900 + i), *notes, f"Page {i}"])) for i in range(10)]
    rows += [(20 + i, f"{letters(40, 950 + i)}\n{twice}\n{once}") for i in range(2)]
    rows += [(30 + i, f"{letters(40, 960 + i)}\n{thrice}\n{once}") for i in range(3)]
    rows += [(40 + i, f"{letters(40, 970 + i)}\n{letters(25, 43)}\nOnly here") for i in range(2)]
    got = left(spark, rows)
    assert all(got[i] == [rows[i][1].split("\n")[0], f"Page {i}"] for i in range(10))
    assert all(len(got[20 + i]) == 2 and got[20 + i][1] == once for i in range(2))
    assert all(len(got[30 + i]) == 2 and got[30 + i][1] == once for i in range(3))
    assert all(len(got[40 + i]) == 3 for i in range(2))


def test_a_leaf_holds_many_templates(spark):
    messages = [letters(8, 60 + k) for k in range(12)]
    rows = []
    for i in range(120):
        who = letters(1, 2000 + i)  # a field without a digit
        rows.append((i, f"{letters(40, 1000 + i)}\n2024-01-{i} 12:{i} 7{i} {messages[i % 12]} {who}"))
    got = left(spark, rows)
    assert all(got[d] == text.split("\n")[:1] for d, text in rows)


def test_only_candidates_of_near_dedup_get_a_sketch(spark, monkeypatch):
    rows = [(i, letters(40, 3000 + i)) for i in range(30)] + [(100, letters(40, 3000)), (101, f"{letters(40, 3001)} once more")]
    held = []
    whole = near_dups.candidates_of
    monkeypatch.setattr(near_dups, "candidates_of", lambda ids, texts: held.append(whole(ids, texts)) or held[0])
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i for i in range(30)} | {100: 0, 101: 1}
    assert {r.node for r in held[0].select("node").collect()} == {1, 101}  # exact copies are one class


def test_a_signature_may_be_taken_in_part():
    shingles = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (near_dups.signature(shingles, 128) == near_dups.signature(shingles)[:128]).all()
