"""The operators of the llm package against brute force, and on edge rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import decontaminate, html_text, jaccard_join, language_id, line_dedup, mixing, quality_rules, sharding, suffix_dedup, token_files, words

WORDS = "the of and thing ring éclair über año to in on".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def corpus():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 3, 30, 90, 200])), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None])) for i in range(60)]
    base = [t for _, t, _, _ in rows]
    rows += [(100 + i, base[i] + (" tail" if i % 2 else ""), "en", "a") for i in range(30)]
    return [*rows, (200, None, "en", "b"), (201, "", None, None), (202, "  \n \t", "fr", "a"), (203, "x" * 3000, "en", "a"), (None, "no id " * 30, "en", "b"), (7, base[9], "en", "a"), (7, base[9], "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with names that operators use themselves.
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    return df.withColumns({"key": F.lit("k"), "n_words": F.lit(-1), "score": F.lit("s"), "token": F.lit(1), "pass": F.lit("p"), "n_chars": F.length("text").cast("long")}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<nav>menu</nav>", ""),
    ("<html><body><nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three</p><p>x</p></article><footer>f</footer>", "A & B\n\nOne two three\n\nx"),
    ("<body><div class=ad>Buy a lot of things now, really</div><main><p>Text of some length that is the article.</p><script>if (a<b) '</p>'</script><div id='comments'><p>Nice article, long comment that goes on.</p></div><p>End.</p></main></body>", "Text of some length that is the article.\n\nEnd."),
    ("<p>unclosed <b>bold<p>next", "unclosed bold\n\nnext"),
])
def test_main_text(html, want):
    assert html_text.main_text(html) == want


LONG, LESS = "A sentence of the long part that goes on. " * 9, "A sentence of the other part. " * 8


@pytest.mark.parametrize("html, want", [
    (f"<body><article><h1>T</h1><div class=content><p>{LONG}</p></div></article></body>", ["T", LONG]),
    (f"<body><article><h1>T</h1><section><p>{LONG}</p></section><section><p>{LESS}</p></section></article></body>", ["T", LONG, LESS]),
    (f"<body><article><p>a</p><div><div><table><tr><td>{LONG}{LONG}</td><td>x</td></tr></table></div><p>b</p></div></article><div>c</div></body>", ["a", LONG + LONG, "x", "b"]),
    (f"<body><main><h1>T</h1><nav>menu</nav><article><div><p>{LONG}</p></div></article></main></body>", ["T", LONG]),
    (f"<body><div><h1>T</h1><div><p>{LONG}</p></div></div><div><a>x</a><a>y</a></div></body>", ["T", LONG]),
    (f"<body><div><div><div><p>{LONG}</p></div></div></div><div><div><p>{LESS}</p></div></div></body>", [LONG, LESS]),
    (f"<section>{LONG}</section><section>{LONG}</section>", [LONG, LONG]),
])
def test_main_text_is_whole(html, want):
    assert html_text.main_text(html) == "\n\n".join(x.strip() for x in want)


@pytest.mark.parametrize("html, want", [
    (f"<body><div class='post-content no-sidebar'><h1>T</h1><p>{LONG}</p></div></body>", ["T", LONG]),
    (f"<body class='has-comments'><div class='share-ready'><h1>T</h1><p>{LONG}</p><p>short</p></div><div class=comments><p>{LESS}</p></div></body>", ["T", LONG, "short"]),
    (f"<body><form><h1>T</h1><p>{LONG}</p><label>Name</label><button>Send</button></form></body>", ["T", LONG]),
    (f"<body><form><p>{LONG}</p></form></body>", [LONG]),
    (f"<body><p>{LONG}</p><form><p>Your name please, and some more</p></form><p>{LESS}</p></body>", [LONG, LESS]),
    (f"<body><div class=x1>Home About Contact</div><p>{LONG}</p><p>{LESS}</p></body>", [LONG, LESS]),
    (f"<body><div class=x1><a href=1>Home</a> <a href=2>About</a></div><ul><li><a href=3>One</a></li><li><a href=4>Two</a></li></ul><p>{LONG}</p><p>End.</p></body>", [LONG, "End."]),
    (f"<article><p>{LONG}</p><p><a href=1>A link by itself</a></p><p>{LESS}</p></article>", [LONG, "A link by itself", LESS]),
    (f"<article><header><h1>T</h1></header><section><p>{LONG}</p></section><section><p>{LESS}</p><p>x</p></section></article><aside><p>{LESS}</p></aside>", ["T", LONG, LESS, "x"]),
    ("<nav><a href=1>a</a></nav><footer><p>Only a footer with a paragraph.</p></footer>", []),
])
def test_names_lower_and_clusters_decide(html, want):
    assert html_text.main_text(html).split("\n\n") == ([x.strip() for x in want] or [""])


def test_clusters_are_ratio_gaussian_and_threshold():
    rng = random.Random(5)
    for n in (1, 2, 7, 40):
        own = [rng.choice([0, 1, 5, 80.5]) for _ in range(n)]
        soft = []
        for i in range(n):
            near = [(math.exp(-((i - k) ** 2) / (2 * html_text.SIGMA**2)), own[k]) for k in range(n) if abs(i - k) <= 5]
            soft.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        assert np.allclose(html_text.smoothed(np.array(own)), soft)
        mean = sum(soft) / n
        spread = math.sqrt(sum((x - mean) ** 2 for x in soft) / n)
        least = min(spread, mean) if spread > 1e-9 else mean
        chosen, strong = html_text.clusters(np.array(own))
        far = [abs(x - least) > 1e-9 for x in soft]
        assert all(bool(c) == (x >= least) for c, x, f in zip(chosen, soft, far) if f)
        assert all(bool(s) == (x >= least and o >= least and o > 0) for s, x, o, f in zip(strong, soft, own, far) if f)


def test_text_hangs_on_the_clusters(spark):
    """With every line in a cluster, pages with unlabelled menus keep them."""
    every = lambda own: (np.ones(len(own), bool), np.ones(len(own), bool))
    menu = "<div class=x1>Home About Contact</div>"
    pages = [r.html.replace("<article>", f"{menu}<div>").replace("</article>", f"</div>{menu}").replace("<nav>", "<div>").replace("</nav>", "</div>").replace(' class="ad"', "") for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r.html]
    changed = sum(html_text.main_text(p) != html_text.main_text(p, every) for p in pages)
    assert pages and 2 * changed > len(pages)


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "old"), (1, "u", None, "old"), (2, "v", "<p>é</p>", "old")], "page_id long, url string, html string, text string")
    assert rows_of(html_text.extract(pages), "page_id", "text", "n_chars") == [(1, "", 0), (1, "", 0), (2, "é", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


# 2


def test_chunk_ends_move_with_the_lines():
    """Chunks of a passage are the same wherever it stands, but for its first and last lines; a chunk's windows are its own."""
    rng = random.Random(3)
    passage = [f"line {rng.random()}".encode() for _ in range(60)]
    of = lambda lines: [tuple(lines[a:b]) for ends in [line_dedup.chunk_ends(line_dedup.line_hashes(lines)).tolist()] for a, b in zip([0, *ends], ends)]
    plain = of(passage)
    assert sum(map(len, plain)) == 60 and 6 <= len(plain) <= 30
    for n in (1, 2, 7):
        moved = of([f"other {k}".encode() for k in range(n)] + passage + [b"end"])
        assert set(plain[1:-1]) <= set(moved)


def brute_lines(rows, n=2):
    """(doc_id, lines, removed lines, removed runs, text left): what runs of n equal lines in a smaller doc_id, or before in the text, cover."""
    key = lambda i: -math.inf if i is None else i
    lines = [t.split("\n") if t is not None else [] for _, t in rows]
    of = [[tuple(x[k : k + n]) for k in range(len(x) - n + 1)] for x in lines]
    first: dict[tuple, float] = {}
    for (i, _), w in zip(rows, of, strict=True):
        for x in w:
            first[x] = min(key(i), first.get(x, math.inf))
    out = []
    for (i, t), x, w in zip(rows, lines, of, strict=True):
        gone = {k + o for k, y in enumerate(w) if first[y] < key(i) or y in w[: max(0, k - n + 1)] for o in range(n)}
        out.append((i, len(x), len(gone), sum(k - 1 not in gone for k in gone), "\n".join(y for k, y in enumerate(x) if k not in gone) if t is not None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [63, 3])
def test_repeated_lines(spark, docs, empty, bits):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(6))
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 3, 4, 5, 9)]
    rows = [(i, t) for i, t, *_ in corpus()]
    for i in range(40):
        new = [[line() for _ in range(rng.randrange(4))] for _ in range(3)]
        rows.append((300 + i, "\n".join([*new[0], *rng.choice(passages), *new[1], *rng.choice(passages), *new[2]])))
    rows += [(400, "a\na\na"), (401, "b\nb\nb\nb\nb"), (402, "c\n\n\nc\n\n"), (403, "one"), (404, "one"), (None, "\n".join(passages[0]))]
    out = line_dedup.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bits=bits)
    got = rows_of(out, "doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text")
    assert got == brute_lines(rows)
    assert line_dedup.remove_repeated_chunks(empty, bits=bits).count() == 0
    assert set(docs.columns) <= set(line_dedup.remove_repeated_chunks(docs.limit(3)).columns)


def test_chunks_take_what_they_hold(spark, docs, monkeypatch):
    """Windows of chunks that are gone aren't compared again, and without chunks the result is the same."""
    rng = random.Random(8)
    passage = [f"line {rng.random()}" for _ in range(200)]
    rows = [(i, "\n".join([f"own {i}", *passage[i:], f"end {i}"])) for i in range(6)]
    sent = {}
    owned = line_dedup._owned
    monkeypatch.setattr(line_dedup, "_owned", lambda keyed, hashes, n, bits, whole, scratch: sent.__setitem__(whole, hashes.count()) or owned(keyed, hashes, n, bits, whole, scratch))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = rows_of(line_dedup.remove_repeated_chunks(df), "doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text")
    assert out == brute_lines(rows)
    assert sent[True] > 100 and sent[False] < 6 * 200 / 2
    monkeypatch.setattr(line_dedup, "MEAN", 1 << 40)
    monkeypatch.setattr(line_dedup.chunk_ends, "__defaults__", (2, 1 << 40))
    assert rows_of(line_dedup.remove_repeated_chunks(df), "doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text") == out


def test_line_query_takes_short_passages(spark, tmp_path):
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(6))
    passages = [[line() for _ in range(n)] for n in (2, 3, 4, 8)]
    rows = [(i, "\n".join([line(), *passages[i % 4], line()])) for i in range(16)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(line_dedup.op2_line_chunks(spark, str(tmp_path)), "doc_id", "n_removed_lines")
    assert got == sorted([(i, 0 if i < 4 else len(passages[i % 4])) for i in range(16)], key=repr)


# 3


def test_repeated_strings(docs, empty):
    out = {(r.doc_id, r.n_bytes, hashlib.md5(bytes(r.kept)).hexdigest(), len(r.run_starts)) for r in suffix_dedup.remove_repeats(docs, 50).collect()}
    data = [(-1 if i is None else i, (t or "").encode()) for i, t, *_ in corpus()]
    first: dict[bytes, int] = {}
    for i, b in data:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    want = set()
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        runs = int((gone[1:] < gone[:-1]).sum())
        want.add((None if i == -1 else i, len(b), hashlib.md5(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest(), runs))
    assert out == want
    assert suffix_dedup.remove_repeats(empty, 50).count() == 0


def test_matching_statistics():
    strings = [b"abracadabra", b"cadabra", b"abra", b"xyz"]
    index = suffix_dedup.RunIndex(strings)
    neighbour, agree = index.statistics(20)
    text = index.text
    suffix = lambda i: bytes((text[i : i + list(text[i:]).index(0)] - 1).astype(np.uint8))
    for i in range(len(text)):
        if neighbour[i] >= 0 and text[i]:
            a, b = suffix(i), suffix(neighbour[i])
            k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert k == agree[i] and b <= a


# 4


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    for a, b in ((0, 1000), (3, 3), (17, 999)):
        assert (token_files.unpack(data, bits, a, b) == ids[a:b]).all()


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(300, "Don't STOP.. İstanbul Ǆ é ﬁ x y <|endoftext|> z,, 3.14 l'été"), (301, "a\x1cb\x0bc")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    token_files.write_token_files(both, f"{tmp_path}/t", path, 2, partitions=3, block_ids=64)
    rows = token_files.read_token_files(spark, f"{tmp_path}/t").collect()
    want = Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in ((r.doc_id, r.text) for r in both.collect()))
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    ids = [i for r in rows for i in r.ids]
    assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) for r in rows)])[:-1].tolist()
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    digests = {(r.start, r.n_tokens, r.ids_crc32) for r in token_files.document_digests(spark, f"{tmp_path}/t").collect()}
    assert digests == {(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}
    part = sorted((r.position, r.id) for r in token_files.read_range(spark, f"{tmp_path}/t", 50, 300).collect())
    assert part == list(enumerate(ids))[50:300]
    assert token_files.token_table(empty).count() == 0


# 5


def brute_hits(text, items):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for i, t in items:
        w = decontaminate.words_of(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            window = w[k : k + 13]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(i)
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, docs, empty):
    rng = random.Random(1)
    items = [(i, prose(rng, n)) for i, n in enumerate([0, 1, 2, 5, 13, 14, 40])] + [(9, corpus()[70][1]), (9, "thing"), (10, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute_hits(t, items)) for i, t, *_ in corpus()), key=repr)
    for kw in ({}, {"shard_words": 50}, {"block_bytes": 300}):
        out = decontaminate.locate(docs, bench, **kw).withColumn("n_hit", decontaminate.n_hit())
        assert rows_of(out, "doc_id", "n_words", "n_hit", "item_ids") == want
    assert decontaminate.locate(docs, bench.limit(0)).filter("size(item_ids) > 0").count() == 0
    assert decontaminate.locate(empty, bench).count() == 0


def test_items_without_id_are_searched(spark, tmp_path):
    import duckdb

    long = " ".join(f"w{k}" for k in range(20))
    texts = [f"a b {long} c", "thing here", f"other {long} and thing", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, long), (None, long + " more"), (3, "thing"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(decontaminate.OP5_SQL).fetchall())
    assert sorted(map(tuple, decontaminate.op5_fm_index_decontamination(spark, str(tmp_path)).collect())) == want
    docs, bench = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("documents", "benchmark"))
    assert rows_of(decontaminate.locate(docs, bench, block_bytes=60), "doc_id", "item_ids") == [(0, [None]), (1, [3]), (2, [3, None]), (3, []), (4, [])]


# 6


def test_language(spark, docs, empty):
    profiles = language_id.learn(docs.filter(~language_id.held_out()))
    assert set(profiles) == {"en", "fr"}
    out = language_id.predict(docs, profiles)
    assert out.count() == docs.count() and {r[0] for r in out.select("lang_pred").filter("text is null or not text rlike '\\\\p{L}'").collect()} == {"und"}
    assert out.filter("score < 0 or score > 1").count() == 0
    assert language_id.predict(empty, profiles).count() == 0 and language_id.learn(empty) == {}
    assert language_id.predict(docs, {}).filter("lang_pred <> 'und'").count() == 0


def test_language_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op6_rank_order_language(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang", "text"), "doc_id").filter("held_out and length(text) >= 100")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


# 7


def test_growth_moves_only_into_the_new_shard(docs, empty):
    out = sharding.shard_documents(docs)
    assert out.filter("shard <> grown_shard and grown_shard <> 24").count() == 0
    for r in out.groupBy("shard").agg(F.array_sort(F.collect_list("slot")).alias("s")).collect():
        assert r.s == list(range(len(r.s)))
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in corpus()), key=repr)
    assert rows_of(out, "doc_id", "size", "text_crc32") == want
    assert sharding.shard_documents(empty).count() == 0


def test_weights_move_only_their_subtree(spark):
    keys = spark.range(3000)
    place = lambda w: {r.id: (r.region, r.rack, r.shard) for r in sharding.assign(keys, "id", sharding.tree(24, weights=w), parents=True).collect()}
    even, heavy = place({}), place({5: 3.0})
    moved = [k for k in even if even[k] != heavy[k]]
    assert moved and all(heavy[k][2] == 5 for k in moved)
    share = Counter(v[2] for v in heavy.values())
    assert 2 < share[5] / np.mean([share[s] for s in range(24) if s != 5]) < 4.5


def test_tree_is_the_sql(spark):
    import duckdb

    rows = sharding.shard_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(tuple, rows.collect())) == sorted(con.execute(sharding.OP7_SQL).fetchall())


# 8


@pytest.mark.parametrize("target, budget", [(mixing.Target("repetition", 1.5), None), (mixing.Target("entropy", 0.99), 4000), (mixing.Target("repetition", 2.0), 9000)])
def test_mixture_keeps_its_budget(docs, target, budget):
    counts = mixing.token_counts(docs)
    plan = mixing.plan(counts, target, budget, seed=3)
    out = mixing.realise(docs.withColumn("n", mixing.n_tokens()), plan, 3, 4)
    by = {r.source: r for r in plan.collect()}
    got = {r.source: r for r in out.groupBy("source").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    for s, p in by.items():
        if p.tokens:
            assert p.whole * p.tokens + p.rest <= got[s].n + 0 if s in got else p.whole * p.tokens + p.rest == 0
            assert s not in got or got[s].n < p.whole * p.tokens + p.rest + 3 * got[s].most + 1
    assert out.filter("block < 0 or block > 3").count() == 0
    if target.kind == "repetition" and budget is None:
        assert max(p.whole + (p.rest > 0) for p in by.values()) <= 2 and {r[0] for r in out.select("doc_id").collect()} == {i for i, *_ in corpus()}


def test_mixture_of_nothing(empty):
    counts = mixing.token_counts(empty)
    assert mixing.realise(empty, mixing.plan(counts, mixing.TARGET)).count() == 0


# 9


def brute_components(rows, size, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").lower().encode().decode().split()
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    label = list(range(len(rows)))
    for _ in rows:
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and den * len(x & y) >= num * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, s), g in zip(sets, label, strict=True):
        if s and i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, len(s), least.get(g, i) if s else i) for (i, s), g in zip(sets, label, strict=True)), key=repr)


@pytest.mark.parametrize("size, num, den", [(3, 9, 10), (2, 1, 2)])
def test_components(spark, docs, size, num, den):
    # ASCII only: brute force lowers by Python's rules.
    rng = random.Random(2)
    rows = []
    for base in range(6):
        words = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)]
        for k in range(7):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(60)] = f"edit{rng.randrange(1000)}"
            rows.append((base * 10 + k, " ".join(w)))
    rows += [(90, "one two"), (91, "One TWO"), (92, ""), (93, None), (94, " "), (5, "other words here now"), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit(1))
    got = rows_of(jaccard_join.link_components(df, size, num, den), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, size, num, den)
    assert jaccard_join.link_components(df.limit(0), size, num, den).count() == 0


def test_components_of_rows_without_id(spark):
    words = [f"w{k}" for k in range(60)]
    near = lambda k, base=words: " ".join([*base[:-1], f"edit{k}"])
    other, third = ([f"{c}{k}" for k in range(60)] for c in "xy")
    rows = [(1, near(1)), (None, near(2)), (None, near(3, other)), (None, near(4, other)), (None, near(4, other)), (7, near(5, third)), (7, near(6, third)), (None, near(7, third)), (None, None), (9, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard_join.link_components(df, 3, 9, 10), "doc_id", "n_shingles", "component_id") == brute_components(rows, 3, 9, 10)


def test_hot_tokens_and_blocks(spark, monkeypatch):
    """Salted tokens, groups of many blocks and several labels: no link is lost."""
    for name, value in (("HOT", 2), ("BLOCK", 2), ("COUNTED", 50), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(24)]
    rows = []
    for k in range(60):
        w = list(words)
        for _ in range(k % 6):
            w[rng.randrange(24)] = f"edit{rng.randrange(5)}"
        rows.append((k, " ".join(w[: 24 - k % 3])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows, 1, 9, 10)
    assert 1 < len({c for _, _, c in want}) < 60
    assert rows_of(jaccard_join.link_components(df, 1, 9, 10), "doc_id", "n_shingles", "component_id") == want


def test_orders_filter_candidates(spark):
    """A pair without a common token under the second order is not compared, though sizes and the third order allow it."""
    pairs = spark.createDataFrame([("both", 10, 10, [1], [1, 2], [3], [3]), ("third", 10, 10, [1], [2], [3], [3]), ("second", 10, 10, [1], [1], [3], [4]), ("size", 10, 4, [1], [1], [3], [3])], "a string, n int, m int, p1 array<int>, q1 array<int>, p2 array<int>, q2 array<int>")
    kept = lambda *ranks: {r.a for r in jaccard_join.agreeing(pairs, 9, 10, ranks).collect()}
    assert kept(1, 2) == {"both"} and kept(2) == {"both", "third"} and kept(1) == {"both", "second"}


@pytest.mark.parametrize("rank", [0, 1, 2])
def test_similar_sets_share_a_prefix_token(rank):
    rng = np.random.default_rng(3)
    tokens = np.unique(rng.integers(0, 1 << 63, 400, np.uint64))
    orders = jaccard_join.Orders(tokens[::5], rng.integers(2, 1000, len(tokens[::5])))
    for _ in range(50):
        x = np.sort(rng.choice(tokens, rng.integers(1, 200), False))
        y = np.unique(np.append(rng.choice(x, max(1, len(x) - int(rng.integers(0, 9))), False), rng.choice(tokens, int(rng.integers(0, 5)))))
        prefix = [set(t.tolist()) for s in (x, y) for _, t, _ in orders.prefixes(s, jaccard_join.longer_prefix(len(s), 4, 5), (rank,))]
        both = len(np.intersect1d(x, y))
        least = max(jaccard_join.shared_least(len(s), 4, 5) for s in (x, y))
        assert 5 * both < 4 * (len(x) + len(y) - both) or len(prefix[0] & prefix[1]) >= least >= 1


@pytest.mark.parametrize("num, den", [(4, 5), (9, 10), (1, 1), (1, 2)])
def test_shared_prefix_tokens_of_all_sizes(spark, num, den):
    """The least number is that of the worst partner, and the column says the same."""
    longer = lambda n: jaccard_join.longer_prefix(n, num, den) - jaccard_join.prefix_length(n, num, den)
    least = {n: jaccard_join.shared_least(n, num, den) for n in range(1, 400)}
    for n, k in least.items():
        partners = [m for m in range(1, 800) if den * min(n, m) >= num * max(n, m)]
        assert 1 <= k <= 1 + min(longer(m) for m in [n, *partners])
    df = spark.createDataFrame([(n, k, d) for n, k in least.items() for d in (-1, 0, 1)], "n int, k long, d int")
    assert df.filter(jaccard_join.shared_enough(F.col("k") + F.col("d"), F.col("n"), num, den) != (F.col("d") >= 0)).count() == 0


def test_shingles_of_long_texts(monkeypatch):
    rng = random.Random(1)
    texts = ["", None, " ", "x" * 500, *(" ".join(rng.choice(["a", "é", "Word", "y" * 90, "", "\n"]) for _ in range(n)) for n in (1, 2, 3, 60, 400))]
    whole = [s.tolist() for t in texts for s in jaccard_join.sets_of(pa.array([t], pa.string()), 3)]
    assert [len(s) for s in whole] == [n for _, n, _ in (brute_components([(0, t)], 3, 1, 1)[0] for t in texts)]
    monkeypatch.setattr(words, "CHUNK", 64)
    assert [s.tolist() for s in jaccard_join.sets_of(pa.array(texts, pa.string()), 3)] == whole


# 10


def test_rules(docs, empty):
    def brute(t):
        words = (t or "").encode().split()
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + o for k, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for o in range(3)}
        lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
        return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)

    book = quality_rules.ledger(docs)
    assert rows_of(book, "doc_id", *quality_rules.MEASURES[:5]) == sorted(((i, *brute(t)) for i, t, *_ in corpus()), key=repr)
    masks = [r.failed for r in book.collect()]
    mask = quality_rules.mask_of(quality_rules.POLICIES["v1"])
    for r in quality_rules.ablations(book, "v1").collect():
        bit = 1 << quality_rules.RULES[r.rule][0]
        assert r.n_failed == sum(bool(m & bit) for m in masks)
        assert r.n_rejected_alone == sum(m & mask == bit for m in masks)
        assert r.n_kept == sum(m & mask == 0 for m in masks)
    assert quality_rules.ablations(quality_rules.ledger(empty), "v1").filter("n_kept > 0").count() == 0
    assert quality_rules.any_all_failed(book.withColumn("g", F.lit(1)), "g").count() == 1
