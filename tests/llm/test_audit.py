"""The filter interaction audit against plain sets of surviving documents."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlane.llm import audit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def long_text(i, n=80):
    return " ".join(f"w{i}x{k}" for k in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    texts = ["", None, "short", long_text(1), long_text(1), "same " * 60, "ABC DEF " + long_text(2), "CAPS " * 70,
             long_text(3) + " 100%", "a b\x85c " * 30, "ÄÖÜ " * 60, long_text(4, 60_000), long_text(5) + "\x0b\x0c|",
             long_text(6)]
    rows = [(i, texts[i % len(texts)], f"s{i % 3}" if i % 5 else None) for i in range(100, 190)]
    rows += [(i, long_text(1), "s1") for i in range(300, 345)]      # a third of the rows share a text
    rows += [(1, long_text(7), "s1"), (1, long_text(7), "s1"), (None, long_text(7), "s2"), (None, long_text(7), None)]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(100, 170, 2)] + [(i, 1, None) for i in range(101, 130, 2)]
    labels += [(101, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit("x") for c in ("part", "fails", "digest", "good", "toxic", "first", "row", "bit", "subset")})
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute(docs, labels):
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs]
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    fails = []
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = set()
        if len(words) < 50:
            f.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            f.add("C")
        if re.search("[#$%&*|]", text):
            f.add("D")
        if i is not None and any(j is not None and j < i and t == text for j, t, _ in rows):
            f.add("E")
        fails.append(f)
    out = {}
    for part in {p for _, _, p in rows}:
        here = [k for k, r in enumerate(rows) if r[2] == part]
        gone = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(here)
            for step, f in enumerate(order, 1):
                failing = {k for k in here if f in fails[k]}
                lost = failing & left
                gone[f] += len(lost)
                out[part, "".join(order), step] = [
                    len(left - lost), len(lost), len(failing - left), sum(fails[k] == {f} for k in here),
                    sum(rows[k][0] in good for k in lost), sum(rows[k][0] in toxic for k in lost)]
                left -= lost
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(gone[order[step - 1]])
    return out


def test_every_figure_of_every_order(tables):
    docs, labels = tables
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in audit.audit(docs, labels).collect()}
    assert got == brute(docs.collect(), labels.collect())


def test_empty_tables(tables):
    docs, labels = tables
    assert audit.audit(docs.limit(0), labels).count() == 0
    got = audit.audit(docs, labels.limit(0))
    assert got.where("good_lost <> 0 or toxic_lost <> 0").count() == 0 and got.count() == 600 * 4


def test_positional_popcount():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 7, 1000, 4097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        want = [(int(b)) for b in ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(0)]
        assert audit.positional_popcount(words).tolist() == want


def test_survival_words():
    words = audit.survival_words(5)
    for fails in range(32):
        assert [bool(int(words[fails]) >> s & 1) for s in range(32)] == [s & fails == 0 for s in range(32)]


def test_fewer_filters(spark):
    marked = spark.createDataFrame([("p", f, False, False) for f in (0, 1, 1, 2, 3)], "part string, fails int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): [r[c] for c in COLUMNS]
           for r in audit.interactions(audit.survivors(marked, 2), "XY").collect()}
    assert got == {("XY", 1): [2, 3, 0, 2, 0, 0, 5], ("XY", 2): [1, 1, 1, 1, 0, 0, 3],
                   ("YX", 1): [3, 2, 0, 1, 0, 0, 3], ("YX", 2): [1, 2, 1, 2, 0, 0, 5]}
