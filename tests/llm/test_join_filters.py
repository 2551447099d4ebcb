"""What the join's filters leave, counted on the way."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.llm import jaccard_join
from framewright.llm.common import Scratch


class Counting(Scratch):
    """Keeps the row counts of stored tables by name."""

    def __init__(self, spark):
        super().__init__(spark, "counted")
        self.counts: dict[str, list[int]] = {}

    def stored(self, df, name):
        out = super().stored(df, name)
        self.counts.setdefault(name, []).append(out.count())
        return out


@pytest.mark.parametrize("size, num, den", [(3, 9, 10), (5, 4, 5)])
def test_orders_leave_few_classes(spark, size, num, den):
    """Most classes are done after the first order, and no link is lost by what the filters ask."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    scratch = Counting(spark)
    rows = jaccard_join.linked(docs, size, num, den, scratch).collect()
    sets = {r["doc_id"]: set(s.tolist()) for r in docs.collect() for s in [jaccard_join.shingles(r["text"], size)]}
    classes = {frozenset(s) for s in sets.values() if s}
    first, all_three = scratch.counts["keys"][0], scratch.counts["classes"][0]
    assert all_three <= first < len(classes) / 3
    # Links between classes, by the tokens that they share.
    holders: dict[int, list[frozenset]] = {}
    for s in classes:
        for t in s:
            holders.setdefault(t, []).append(s)
    shared = Counter((a, b) if id(a) < id(b) else (b, a) for held in holders.values() if len(held) < 200 for i, a in enumerate(held) for b in held[:i])
    label = {r["doc_id"]: r["label"] for r in rows}
    of = {frozenset(s): label[i] for i, s in sets.items() if s}
    links = [(a, b) for (a, b), n in shared.items() if den * n >= num * len(a | b)]
    assert links and all(of[a] == of[b] for a, b in links)
    scratch.clear()


def test_chance_meetings_are_not_enough(spark):
    """Two long sets that share one rare shingle meet, and are out after the first order."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(200))
    rows = [(k, text(k) + " the same three words") for k in range(20)] + [(100, text(0) + " the same three words now")]
    scratch = Counting(spark)
    got = {(r["doc_id"], r["label"]) for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10, scratch).collect()}
    assert len({x for _, x in got}) == 20 and len({x for i, x in got if i in (0, 100)}) == 1
    assert scratch.counts["keys"][0] == 2
    scratch.clear()


def test_links_of_near_copies_stay_few(spark):
    """In a large group of near copies the pairs that go on don't grow with its square, and its components are those of all pairs."""
    rng = random.Random(4)
    sets = []
    for k in range(300):
        places = set(rng.sample(range(13), 10))
        sets.append({f"w{i}" if i not in places else f"edit{k}x{i}" for i in range(100)})
    near = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    label = list(range(len(sets)))
    links = [(a, b) for b in range(len(sets)) for a in range(b) if near(sets[a], sets[b])]
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    assert len(links) > 10 * len(sets)
    scratch = Counting(spark)
    rows = jaccard_join.linked(spark.createDataFrame([(k, " ".join(sorted(s))) for k, s in enumerate(sets)], "doc_id long, text string"), 1, 4, 5, scratch).collect()
    least = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        least.setdefault(r["label"], r["doc_id"])
    assert [least[r["label"]] for r in sorted(rows, key=lambda r: r["doc_id"])] == label
    assert sum(scratch.counts["pairs"] + scratch.counts["links"]) <= 6 * len(sets)
    scratch.clear()
