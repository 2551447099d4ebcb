"""Words, texts and pages that are long or oddly made."""

from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import html_text, jaccard_join, suffix_dedup, token_files, words

LONG = "A sentence of the long part that goes on. " * 9
NAMES = [f"Name{i} Person" for i in range(10)]


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers

    return token_files.WordIds(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("n", [31, 32, 33, 64, 512, 1024, 4096])
def test_ids_of_long_words(coder, n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    texts = pa.array([f"{a} x {b}", b, a.upper(), b + ".", f"{b},{a}", "é" * n])
    assert [x.tobytes() for x in coder.of(texts)] == coder._encoded(texts.to_pylist())


def test_ids_where_hashes_meet(coder):
    """Words of one hash are told apart by their bytes, in a part and against those that are remembered."""
    few = lambda data, begins, found=words.word_hashes: (lambda h, start, last: (h % np.uint64(3), start, last))(*found(data, begins))
    with mock.patch.object(words, "word_hashes", few):
        coder._forget()
        for texts in (["one two three", "four five six", "", None, "one four"], ["seven"], ["two eight"]):
            assert [x.tobytes() for x in coder.of(pa.array(texts, pa.string()))] == coder._encoded([t or "" for t in texts])
    coder._forget()


def test_long_words_dont_link(spark):
    a = thue_morse(512)
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.link_components(docs, 3, 9, 10).collect()} == {(1, 1), (2, 2), (3, 1)}


@pytest.mark.parametrize("fill", [b"q", b"0123456789"])
def test_anchors_hang_on_the_window_alone(fill, monkeypatch):
    """A window selects the same place wherever it stands, also beside the cuts of a long text."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 5000).astype(np.uint8)
    window = np.frombuffer((fill * 50)[:50], np.uint8)
    own = suffix_dedup.anchors(window, 50)
    for at in (*range(940, 1010), 1999, 2000, 2001, 4950):
        b = text.copy()
        b[at : at + 50] = window
        h, first, last, place = suffix_dedup.anchors(b, 50)
        k = np.searchsorted(first, at, "right") - 1
        assert h[k] == own[0][0] and place[k] - at == own[3][0] and last[k] >= at
        assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and last[-1] == len(b) - 50 and (np.diff(place) > 0).all()


@pytest.mark.parametrize("together, piece", [(1 << 18, 1 << 22), (200, 1 << 22), (1, 1 << 22), (500, 300)])
def test_anchors_of_many_texts(monkeypatch, together, piece):
    """Texts taken together have the anchors that each has by itself."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (0, 49, 50, 51, 0, 400, 120, 10, 50, 49, 90, 1000, 60, 0)]
    got = {}
    for at, text, *columns in suffix_dedup.anchors_of(texts, 50):
        for k, *row in zip(text.tolist(), *(c.tolist() for c in columns)):
            got.setdefault(at + k, []).append(tuple(row))
    want = {k: list(zip(*(c.tolist() for c in suffix_dedup.anchors(np.frombuffer(t, np.uint8), 50)))) for k, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}


def test_repeats_at_cuts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = letters(50)
    docs = [(1, letters(100) + passage + letters(20))] + [(2 + k, letters(240 + k) + passage + letters(200)) for k in range(0, 70, 3)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 50)
    want, seen = set(), set()
    for i, t in docs:
        own = [t[k : k + 50] for k in range(len(t) - 49)]
        hit = {k + x for k, s in enumerate(own) if s in seen for x in range(50)}
        want.add((i, tuple(k for k in sorted(hit) if k - 1 not in hit), tuple(k + 1 for k in sorted(hit) if k + 1 not in hit)))
        seen.update(own)
    assert len([w for w in want if w[1]]) == 24
    assert {(r["doc_id"], tuple(r["run_starts"]), tuple(r["run_ends"])) for r in out.collect()} == want


@pytest.mark.parametrize("hot", [1 << 25, 3000, 0])
def test_repeats_of_hot_anchors(spark, monkeypatch, hot):
    """A passage in a third of the documents, with other bytes around it in each: the same result when its windows are spread over tasks."""
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(map(chr, rng.integers(97, 100, n)))
    passage = letters(120)
    docs = [(i, letters(60) + (passage[: 120 - i % 7] if i % 3 == 0 else "") + letters(60)) for i in range(90)] + [(None, letters(80) + passage), (4, passage)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 50)
    seen: dict[str, float] = {}
    for i, t in docs:
        for k in range(len(t) - 49):
            seen[t[k : k + 50]] = min(seen.get(t[k : k + 50], 1e9), -1 if i is None else i)
    want = []
    for i, t in docs:
        hit = {k + x for k in range(len(t) - 49) if seen[t[k : k + 50]] < (-1 if i is None else i) for x in range(50)}
        want.append((i, "".join(c for k, c in enumerate(t) if k not in hit).encode()))
    assert sorted(((r["doc_id"], bytes(r["kept"])) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_nothing_is_left_behind(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG + "x")], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    scratch = suffix_dedup.Scratch(spark, "repeats")
    assert suffix_dedup.remove_repeats(docs, 50, scratch).count() == 2
    scratch.clear()
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("page, kept", [
    ("<body><nav><a>x</a></nav><article><h1>T</h1><p>{long}</p><table>{rows}</table><p>{long}</p></article></body>", NAMES),
    ("<body><div><h1>T</h1><p>{long}</p><table>{rows}</table><p>{long}</p></div></body>", NAMES),
    ("<body><article><h1>T</h1><p>{long}</p><ul>{items}</ul><p>{long}</p></article></body>", NAMES),
    ("<article><p>{long}</p><blockquote class=social>Name1 Person</blockquote></article>", NAMES[1:2]),
    ("<article><p>{long}</p><div class=related-work><p>Name1 Person</p></div></article>", NAMES[1:2]),
    ("<article><p>{long}</p><div class=login-guide><p>Name1 Person</p></div></article>", NAMES[1:2]),
    ("<article><p>{long}</p><div class='related links'>{items}</div></article>", []),
    ("<article><p>{long}</p><div class=related-post>Name1 Person</div></article>", []),
    ("<article><p>{long}</p><div class=comment-by-reader>Name1 Person</div><div class=comment-by-reader>Name2 Person</div></article>", []),
])
def test_linked_lines_and_names(page, kept):
    rows = "".join(f"<tr><td><a href=x>{n}</a></td><td>{i} figures beside it</td></tr>" for i, n in enumerate(NAMES))
    items = "".join(f"<li><a href=x>{n}</a></li>" for n in NAMES)
    text = html_text.main_text(page.format(long=LONG, rows=rows, items=items))
    assert [n for n in NAMES if n in text.split("\n\n")] == kept and LONG.strip() in text


@pytest.mark.parametrize("times", [1, 5, 50])
def test_comments_in_an_article_go_however_long(times):
    comment = "<div class=comment>" + "reader says so " * 30 * times + "</div>"
    page = f"<article><h1>T</h1><p>Short paragraph of it.</p><p>Another short one.</p><section class=comments>{comment * 3}</section></article>"
    assert html_text.main_text(page) == "T\n\nShort paragraph of it.\n\nAnother short one."
