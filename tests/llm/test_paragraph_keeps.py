"""Paragraph dedup keeps one copy of everything, whatever the ids."""

import random

from marketloom.llm.paragraph_dedup import paragraph_dedup

KIND = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]


def left_of(text, row):
    """What is kept of a text: without the bytes of removed lines and spans."""
    data, gone = text.encode(), set()
    at = 0
    for i, line in enumerate(text.split("\n")):
        size = len(line.encode())
        if i in row.removed_lines:
            gone.update(range(at, at + size))
        at += size + 1
    for s in row.removed_spans:
        gone.update(range(s.a, s.b))
    return bytes(b for i, b in enumerate(data) if i not in gone).decode(errors="replace")


def test_a_removed_line_takes_no_last_copy_along(spark):
    rng, rows, changed_runs = random.Random(7), [], []
    for k in range(12):
        line = words(rng, 150)
        at = rng.randrange(40, 90)
        near = line[:at] + words(rng, 12) + line[at + 12 :]
        changed_runs.append(near[at : at + 12])
        third = words(rng, 30) + near[at - 20 : at + 35] + words(rng, 30)
        rows += [(10 * k, " ".join(line)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(third))]
    got = {r.doc_id: r for r in paragraph_dedup(spark.createDataFrame(rows, KIND)).collect()}
    kept = " ".join(left_of(t, got[i]) for i, t in rows)
    assert all(got[10 * k + 1].n_removed == 1 for k in range(12))
    lost = [pair for run in changed_runs for pair in zip(run, run[1:]) if " ".join(pair) not in kept]
    assert lost == []
    for i, t in rows:  # a span is of pieces, each of which is kept somewhere
        for s in got[i].removed_spans:
            assert all(word in kept for word in t.encode()[s.a : s.b].decode().split())


def test_ids(spark):
    rng = random.Random(8)
    long, other, third = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(1, long), (None, long), (None, long), (None, other), (2, third), (2, f"{words(rng, 1)[0]}\n{long}"), (None, None), (3, ""), (2, third)]
    docs = spark.createDataFrame(rows, KIND)
    got = paragraph_dedup(docs).collect()
    assert len(got) == len(rows)
    marked = sorted((str(r.doc_id), r.n_removed, r.kept_in, r.repeated) for r in got)
    # both rows without an id hold the text that document 1 keeps, and so does a text under the id that two texts share
    assert marked.count(("None", 1, [1], True)) == 2 and marked.count(("None", 0, [], False)) == 2
    assert marked.count(("2", 1, [1], True)) == 1 and marked.count(("2", 0, [], False)) == 2 and ("1", 0, [], True) in marked
