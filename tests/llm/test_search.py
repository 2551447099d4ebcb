"""Exact top-k search, ranked lexical search and vector codes against brute force, and on edge rows."""

import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import lexical_search, metric_tree, vector_codes
from framewright.llm.vectors import integers

NAN, INF = float("nan"), float("inf")


def vectors(n=700, width=12):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, width))
    rows = [(i, [float(x) for x in centres[i % 5] * (1 + i % 3) + rng.normal(size=width) * 0.05], i % 4) for i in range(n)]
    rows += [(n + i, rows[7][1], None) for i in range(250)]  # copies of one vector, a fourth of all rows
    rows += [(2000, None, 1), (2100, [1.0, None], 1), (2200, [NAN] * width, 2), (2300, [INF] * width, 2), (2400, [], 3), (2500, [1.5, -2.5], None), (None, rows[3][1], 0), (None, None, None), (10, rows[10][1], 2), (10, rows[10][1], 2), (100, rows[200][1], 0)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    return df.withColumns({"score": F.lit("s"), "rank": F.lit(1), "tree": F.lit("t"), "code": F.lit("c"), "id": F.lit("i")}).repartition(7).cache()


def kept(scale, width=12):
    out = []
    for i, v, label in vectors():
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(scale * float(np.float32(c))) for c in v]
            out.append((i, x + [0] * (width - len(x)), label))
    return out


# 11


def brute_search(rows, queries, k):
    want = set()
    for q, v in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, x)), math.inf if i is None else i) for i, x, _ in rows if i != q))[:k]
        want |= {(q, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(scored)}
    return want


@pytest.mark.parametrize("tree, page, root, block", [(4096, 64, 4096, 512), (50, 8, 4, 3)])
def test_metric_tree(spark, table, monkeypatch, tree, page, root, block):
    for name, value in (("TREE_ROWS", tree), ("PAGE_ROWS", page), ("ROOT_ROWS", root), ("BLOCK_QUERIES", block)):
        monkeypatch.setattr(metric_tree, name, value)
    index = metric_tree.build(table)
    asked = table.filter("vec_id % 50 = 0")
    got = metric_tree.search(index, asked, k=7)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    rows = kept(1024)
    queries = {(i, tuple(x)) for i, x, _ in rows if i is not None and i % 50 == 0}
    assert len(queries) > 14
    assert {tuple(r) for r in got.collect()} == brute_search(rows, queries, 7)
    assert got.count() == 7 * len(queries)


def test_few_rows_and_no_rows(spark, table):
    few = table.filter("vec_id in (3, 4, 5)")
    found = metric_tree.search(metric_tree.build(few), few)
    assert {tuple(r) for r in found.collect()} == brute_search([r for r in kept(1024) if r[0] in (3, 4, 5)], [(i, x) for i, x, _ in kept(1024) if i in (3, 4, 5)], 10)
    assert metric_tree.search(metric_tree.build(table.limit(0)), few).count() == 0
    assert metric_tree.search(metric_tree.build(few), table.limit(0)).count() == 0
    assert metric_tree.search(metric_tree.build(few), table.filter("embedding is null")).count() == 0


def test_bounds_leave_pages_out():
    """In a clustered tree a search reads a part of the pages, and finds what all of them hold."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 16)) * 3000)[np.repeat(np.arange(40), 50)].astype(np.int64) + rng.integers(-40, 40, (2000, 16))
    space = metric_tree.Space(16, float(np.square(x).sum(1).max()))
    row = metric_tree.grown(x, list(range(2000)), space)
    row |= {"vectors": row["vectors"].tobytes(), "router": row["router"].tobytes()}
    tree = metric_tree.Tree(row, space)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            seen.append(np.size(key))
            return np.asarray(super().__getitem__(key))

    tree.x = tree.x.view(Counted)
    for q in range(0, 2000, 100):
        seen.clear()
        want = sorted((-int(x[q] @ x[i]), i) for i in range(2000) if i != q)[:5]
        assert sorted((-s, i) for i, s in tree.best(x[q], q, 5, None)) == want
        assert sum(seen) < 1000  # pages' routers and entries together


def test_large_components_are_exact_or_an_error(spark):
    rows = [(i, [float(2**16 * (i + 1)), float(-(2**15)), 0.125]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, [math.floor(1024 * c) for c in v], None) for i, v in rows]
    assert {tuple(r) for r in metric_tree.search(metric_tree.build(df), df.filter("vec_id < 4"), k=3).collect()} == brute_search(ints, [(i, x) for i, x, _ in ints[:4]], 3)
    with pytest.raises(Exception, match="64 bits"):
        metric_tree.build(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))


# 12


def items():
    rng = random.Random(8)
    words = "the of Thing éclair über x1 2 naïve 日本 end".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30])))) for i in range(12)]
    return [*rows, (20, None), (21, ""), (22, "--- !!"), (23, "nowhere_at all"), (3, rows[3][1]), (3, "other the"), (None, "The END")]


def texts():
    rng = random.Random(9)
    words = "the The of thing éclair über ÜBER x1 2 naïve 日本 end ending theend other".split()
    rows = [(i, "".join(rng.choice(words) + rng.choice(["  ", ", ", "_", "\n", " ", "\x00", " "]) for _ in range(rng.choice([0, 1, 2, 40, 300])))) for i in range(90)]
    return [*rows, (200, None), (201, ""), (202, " .,"), (203, rows[4][1]), (4, rows[4][1]), (None, rows[7][1]), (204, "the" * 5000), (205, "the end " * 40000)]


def brute_rank(docs, asked, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    counts = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    n_all, total = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
    want = []
    for item, text in set(asked):
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * c.total() * n_all) // total
            score = sum(weight(t) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in term.findall(lower(text)) if c[t])
            if score > 0:
                scored.append((-score, math.inf if i is None else i))
        want += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(want, key=repr)


@pytest.mark.parametrize("pairs, common, chunk, cells", [(1 << 20, 0.25, 1 << 18, 1 << 22), (40, 0.0, 64, 30), (1 << 20, 2.0, 1000, 1 << 22)])
def test_automaton_ranking(spark, monkeypatch, pairs, common, chunk, cells):
    for name, value in (("BLOCK_PAIRS", pairs), ("COMMON", common), ("CHUNK", chunk), ("CELLS", cells)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = spark.createDataFrame(texts(), "doc_id long, text string").withColumns({"item_id": F.lit(1), "score": F.lit("s"), "id": F.lit("i"), "block": F.lit(2)}).repartition(5)
    asked = spark.createDataFrame(items(), "item_id long, text string").withColumns({"doc_id": F.lit(1), "rank": F.lit("r")})
    got = lexical_search.rank(docs, asked)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_rank(texts(), items(), 10)


def test_ranking_of_empty_tables(spark):
    docs, asked = spark.createDataFrame(texts(), "doc_id long, text string"), spark.createDataFrame(items(), "item_id long, text string")
    assert lexical_search.rank(docs.limit(0), asked).count() == 0
    assert lexical_search.rank(docs, asked.limit(0)).count() == 0
    assert lexical_search.rank(docs.filter("text is null"), asked).count() == 0


def test_neighbours_share_their_blank():
    block = lexical_search.Items([1], ["a b"])
    found = list(lexical_search.counted(pa.array(["a b a", "ab", None, "b", "A.B"]), block))
    assert [x.tolist() for x in found[0][1:]] == [[3, 1, 0, 1, 2], [0, 0, 3, 4, 4], [0, 1, 1, 0, 1], [2, 1, 1, 1, 1]]


# 13


def brute_codes(rows, parts=8, entries=16, rounds=6):
    width = max((len(x) for _, x, _ in rows), default=0)
    size = max(1, -(-width // parts))
    cut = [[(x + [0] * (parts * size))[p * size : (p + 1) * size] for p in range(parts)] for _, x, _ in rows]
    first = sorted(range(len(rows)), key=lambda r: (math.inf if rows[r][0] is None else rows[r][0], rows[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v, e)), c) for c, e in enumerate(books[p])) for p, v in enumerate(row)] for row in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            groups: dict[int, list] = {}
            for r, row in enumerate(got):
                groups.setdefault(row[p][1], []).append(cut[r][p])
            for c, own in groups.items():
                books[p][c] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in row) for row in got]
    by = Counter()
    for (_, _, label), e in zip(rows, error):
        by[label] += e
    return sorted(((i, "".join(f"{c:02x}" for _, c in row), e, by[label], digest) for (i, _, label), row, e in zip(rows, got, error)), key=repr)


def test_walsh_codes(spark, table):
    books = vector_codes.train(table)
    coded = vector_codes.with_label_error(vector_codes.encode(table, books).cache())
    got = sorted(((r["id"], r["code"], r["error"], r["label_error"], books.digest()) for r in coded.collect()), key=repr)
    assert got == brute_codes(kept(4096))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_codes_of_few_rows(spark, n):
    rows = [(i, [float(i), 0.5 * i, -1.0], "a" if i % 2 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    books = vector_codes.train(df)
    coded = vector_codes.with_label_error(vector_codes.encode(df, books))
    want = brute_codes([(i, [math.floor(4096 * c) for c in v], label) for i, v, label in rows])
    assert sorted(((r["id"], r["code"], r["error"], r["label_error"], books.digest()) for r in coded.collect()), key=repr) == want


def test_transform_keeps_distances_and_leaves_entries_out():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 8, 13):
        entries = rng.integers(-4000, 4000, (16, size))
        parts = entries[rng.integers(0, 16, 500)] + rng.integers(-60, 60, (500, size))
        entries[5] = entries[2]  # a tie goes to the lower index
        whole = np.square(parts[:, None] - entries).sum(2)
        index, distance, compared = vector_codes.nearest(parts, entries)
        assert (index == whole.argmin(1)).all() and (distance == whole.min(1)).all()
        if size == 13:
            assert compared < 500 * 16 * 16 / 2
    for size in (2, 8, 16):
        signs = (np.diff(vector_codes.sequency(size), axis=1) != 0).sum(1)
        assert signs.tolist() == list(range(size))


def test_integers_of_slices():
    column = pa.array([[1.0, 2.0], None, [0.5], [NAN], [None], [], [-0.3, 0.1]], pa.list_(pa.float32()))
    for at in range(7):
        keep, rows = integers(column.slice(at), 10, 2)
        want = [[10, 20], [5, 0], [0, 0], [-4, 1]]
        mask = [True, False, True, False, False, True, True]
        assert keep.tolist() == mask[at:] and rows.tolist() == want[sum(mask[:at]) :]
