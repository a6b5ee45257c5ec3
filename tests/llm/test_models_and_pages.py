"""Toxicity and quality by held-out accuracy, main text and archives, the pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlane.llm import catalog, html_main, quality, toxicity, warc

SF01 = "/root/testdata/sf0.01"
ODD = [None, "", "   ", "\n", "a", "!!!", "é" * 5000, "word " * 20000, "日本語", "x" * 500]


@pytest.fixture(scope="module")
def labelled(spark):
    """Ordinary and toxic texts of invented words; label 1 of quality for the tidy ones."""
    rng = random.Random(2)
    words = ["".join(rng.choice(["ba", "do", "ki", "lu", "men", "ra", "so", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(["zgrrx", "vuxxo", "qwyzz"]))
        line = " ".join(text) + "."
        docs.append((i, line.upper().replace(" ", "!! ") if poor else line))
        labels.append((i, 0 if poor else 1, int(toxic)))
    docs += [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, "ba do ki"), (7, docs[7][1])]
    labels += [(5001, None, None), (None, 1, 1), (8, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("score", "toxic", "quality", "fold", "held_out", "predicted")})
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator,label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(labelled, operator, label):
    docs, labels = labelled
    got = operator.score(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100
    assert np.mean([p == y for p, y in held]) > 0.95
    import zlib
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert operator.score(docs.limit(0), labels).count() == 0


def test_no_labels_at_all(labelled):
    docs, labels = labelled
    some = docs.where("doc_id < 20 or doc_id >= 5000")
    assert toxicity.keep_ordinary(some, labels.limit(0)).count() == some.count()
    assert quality.keep_good(some, labels.limit(0)).columns == some.columns


def test_kneser_ney_shares_are_whole(labelled):
    """The counts of all groups are the counts of all contexts, in each class and in the
    shared orders."""
    docs, labels = labelled
    model = toxicity.fit(docs, labels).model
    t = {n: np.concatenate(c) for n, c in model.tables.items()}
    assert t["own0"].sum() == t["context0_own"].sum() > 0
    assert t["own1"].sum() == t["context1_own"].sum() > 0
    for k in range(1, toxicity.ORDER):
        assert t[f"shared{k}"].sum() == t[f"context{k}"].sum() > 0


def test_every_letter_group_has_its_own_counts(spark, monkeypatch):
    """However many groups there are, and in however many files, none gets another's counts."""
    monkeypatch.setattr(toxicity, "PIECE_ROWS", 50_000)
    rng = random.Random(9)
    words = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(6)) for _ in range(40_000)]
    rows = [(" ".join(words[k::40]), int(k % 4 == 0)) for k in range(40)]
    model = toxicity._opened(toxicity.fit_counts(spark.createDataFrame(rows, "text string, toxic int")))
    want = [Counter(), Counter()]
    for text, toxic in rows:
        want[toxic].update(g.tobytes() for some, _ in toxicity.letters(text.split(), 1000) for g in some)
    groups = list(want[0] | want[1])
    assert len(groups) > 200_000 and sum(map(len, model.tables["own0"])) == len(groups)
    got = model.find("own", np.frombuffer(b"".join(groups), np.uint32).reshape(-1, toxicity.ORDER))
    for label in (0, 1):
        assert got[label].tolist() == [want[label][g] for g in groups]
    assert sum(c.sum() for c in model.tables["shared4"]) == len(groups)


def plain_kneser_ney(rows):
    """log P(toxic) - log P(ordinary) of a word's letters, from plain counts."""
    def groups(word):
        line = "\1" * 4 + word + "\2"
        return [line[i:i + 5] for i in range(len(word) + 1)]

    own = [Counter(), Counter()]
    for text, toxic in rows:
        own[toxic].update(g for w in toxicity.split_words(text) for g in groups(w))
    level = {5: set(own[0]) | set(own[1])}
    shared = {}
    for k in range(4, 0, -1):
        shared[k] = Counter(g[1:] for g in level[k + 1])
        level[k] = set(shared[k])

    def back(g):
        if not g:
            return 1 / 256
        counts = shared[len(g)]
        same = {x: n for x, n in counts.items() if x[:-1] == g[:-1]}
        low = back(g[1:])
        if not same:
            return low
        total = sum(same.values())
        return max(counts[g] - 0.75, 0) / total + 0.75 * len(same) / total * low

    def one(label, g):
        same = {x: n for x, n in own[label].items() if x[:-1] == g[:-1]}
        low = back(g[1:])
        if not same:
            return low
        total = sum(same.values())
        return (max(own[label][g] - 0.75, 0) + 0.75 * len(same) * low) / total

    return lambda word: sum(math.log(one(1, g)) - math.log(one(0, g)) for g in groups(word))


def test_evidence_is_plain_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE_ROWS", 64)
    rng = random.Random(3)
    rows = [(" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(12)), int(i % 3 == 0)) for i in range(30)]
    rows += [("Aaaa, bbbb! " + "abc" * 30, 1)]
    model = toxicity._opened(toxicity.fit_counts(spark.createDataFrame(rows, "text string, toxic int")))
    plain = plain_kneser_ney(rows)
    texts = [r[0] for r in rows[:6]] + ["zzz new wörd", "abcabc", "", None, "!!", "abc" * 40, "a b"]
    for _ in range(2):  # the second time from the worker's memory
        for text, got in zip(texts, model.evidence(texts), strict=True):
            words = toxicity.split_words(text)
            each = sorted(map(plain, words), reverse=True)
            want = [0.0] * 4
            if words:
                want = [*each[:3], *[min(0.0, each[-1])] * (3 - len(each[:3])), sum(each) / sum(len(w) + 1 for w in words)]
            assert np.allclose(got, want, atol=1e-9)


def test_a_worker_keeps_a_bounded_number_of_words(spark, monkeypatch):
    rows = [("aba cab abc", 1), ("bab aca", 0)]
    model = toxicity._opened(toxicity.fit_counts(spark.createDataFrame(rows, "text string, toxic int")))
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(6)) for _ in range(20)) for _ in range(60)]
    want = model.evidence(texts)
    monkeypatch.setattr(toxicity, "CACHED", 30)
    monkeypatch.setattr(toxicity, "LOT", 300)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    again = toxicity._opened(toxicity.fit_counts(spark.createDataFrame(rows, "text string, toxic int")))
    assert np.allclose(again.evidence(texts), want) and len(again.words) <= 60


def test_one_very_long_word_and_text(spark):
    """Megabytes without a blank, and with blanks, are counted and scored whole."""
    long = "xyz" * 700_000
    rows = [(1, long, 1), (2, "ab cd " * 300_000, 0), (3, "ef gh", 0), (4, "xyz zyx", 1), (6, "ab", 0), (7, "xyz", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 6 and got[1] > got[2]


def test_clashing_names_stay(labelled):
    docs, labels = labelled
    some = docs.where("doc_id < 40").withColumns({c: F.lit("mine") for c in ("toxicity", "Quality", "__toxicity__", "__quality__")})
    for kept in (toxicity.keep_ordinary(some, labels), quality.keep_good(some, labels)):
        assert kept.columns == some.columns
        assert kept.where("toxicity = 'mine' and Quality = 'mine'").count() == kept.count() > 0


@pytest.mark.parametrize("toxic", [1, 2, 3])
def test_few_toxic_labels_still_tell(spark, toxic):
    """However the few toxic ids fall, the models are used."""
    import zlib
    rng = random.Random(4)
    words = ["".join(rng.choice(["ba", "do", "ki", "lu", "men", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    spread = spark.createDataFrame([(i,) for i in ids], "doc_id long").where("pmod(xxhash64(doc_id, 5), 5) > 0").collect()
    marked = {r.doc_id for r in spread[:toxic]}  # none of them in the calibration's fifth
    docs = [(i, " ".join(rng.choice(words) for _ in range(20)) + (" zgrrx vuxxo qwyzz" * 5 if i in marked else "")) for i in ids]
    docs += [(10_001, "zgrrx vuxxo qwyzz zgrrx vuxxo"), (10_002, "ba do ki lu men ra badoki"), (10_003, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in marked)) for i in ids], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, labels).where("doc_id > 10000").collect()}
    assert got[10_001] >= 0.5 > max(got[10_002], got[10_003])


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_tables(x, y)
    assert ((model.scores(x) > 0.5) == (y == 1)).mean() > 0.95
    assert all(len(f) == len(quality.FEATURES) for f in map(quality.features, ODD))


LAYOUT = """<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Menu a</a><li><a href=/b>Menu b</a></ul></nav>
<div class="ad">Buy this now and be glad.</div>
<article><h1>Fish &amp; chips</h1><p><b>First</b> sentence,   with blanks.<br>After the break.<p>Second &lt;tag&gt; here, more text
to read, and so on.</p><form class="newsletter"><p>Sign up</p><input name=q></form></article>
<section id="comments"><p>I do not agree, said a reader.</p></section>
<footer>&copy; Site &middot; all rights</footer>"""
TEXT = "Fish & chips First sentence, with blanks. After the break. Second <tag> here, more text to read, and so on."


@pytest.fixture(scope="module")
def trees(spark):
    return html_main.fit(catalog.table(spark, SF01, "pages"))


def test_main_text(trees):
    assert html_main.main_texts([LAYOUT], trees) == [TEXT]
    odd = [None, "", "<", "<p", "<!-- x", "<script>var a='</p>'", "</div></p>", "<div " * 2000, "<b>" * 3000 + "x"]
    assert len(html_main.main_texts(odd, trees)) == len(odd)
    assert html_main.main_texts([None, ""], None) == ["", ""]


@pytest.mark.parametrize("start", ["<body>", "<body class=x>", "", "<div>"])
def test_main_text_without_an_end_of_the_head(trees, start):
    head, body = LAYOUT.split("</head><body>")
    assert html_main.main_texts([head + start + body], trees) == [TEXT]


def test_implied_ends_of_what_is_dropped():
    def seen(text):
        page = html_main.Page(text)
        return " ".join(page.text(np.ones(len(page.tag), bool)).split())
    assert seen("<head><title>No</title><noscript><p>No</p></noscript>Yes <p>more") == "Yes more"
    assert seen("<head><meta charset=utf-8><p>Yes") == "Yes"
    assert seen("<head><template><p>No</template><link rel=x><article>Yes") == "Yes"
    assert seen("<body><p>Yes<head><p>more") == "Yes more"
    assert seen("<select><option>No<option>No<select><p>Yes") == "Yes"
    assert seen("<select><optgroup><option>No<optgroup><option>No</select><p>Yes") == "Yes"
    assert seen("<table><tr><td><select><option>No<tr><td>Yes</table>") == "Yes"
    assert seen("<p>Yes<select><option>No<input name=q> more") == "Yes more"
    assert seen("<button>No<button>No</button><p>Yes") == "Yes"


def test_pages_are_never_emptied_by_what_else_is_in_the_table(spark):
    """Long pages are learnt from, blank ones take no place in the sample, and without
    any page to learn from there is still a model."""
    long = LAYOUT.replace("var t", "var u='" + "x" * 210_000 + "';var t")
    schema = "page_id long, url string, html string"
    got = html_main.extract(spark.createDataFrame([(k, None, long + f"<p>{k}") for k in range(3)], schema)).collect()
    assert [r.text for r in got] == [TEXT] * 3
    rows = [(None, None, t) for t in (None, "", " \n") for _ in range(200)] + [(k % 2 or None, None, LAYOUT + f"<p>{k}") for k in range(20)]
    got = [r.text for r in html_main.extract(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == [""] * 600 + [TEXT] * 20
    built_in = html_main.fit(spark.createDataFrame([(1, None, "<script>x</script>"), (2, None, None)], schema))
    text, = html_main.main_texts([LAYOUT], built_in)
    assert "Second <tag> here" in text and "Menu" not in text and "all rights" not in text


def test_decoding_has_no_contradictions(trees):
    page = html_main.Page(LAYOUT)
    rng = np.random.default_rng(1)
    for _ in range(50):
        inside = page.decode(rng.random(len(page.tag)))
        for b in range(1, len(page.tag)):
            chain, k = [], b
            while k >= 0:
                chain.append(bool(inside[k]))
                k = page.parent[k]
            assert sum(a != c for a, c in zip(chain, chain[1:], strict=False)) <= 2


def test_main_text_of_the_pages(spark):
    """On the given pages the article element is known, so the text can be held against it."""
    import html
    import re
    got = {r.page_id: r for r in catalog.op8_html(spark, SF01).collect()}
    pages = catalog.table(spark, SF01, "pages").collect()
    assert len(got) == len(pages)
    right = 0
    for p in pages:
        inner = re.search(r"(?s)<article>(.*)</article>", p.html)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|li|ul|div)\b[^>]*>", " ", inner))
        right += got[p.page_id].text == " ".join(html.unescape(inner).split())
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
    assert right / len(pages) > 0.98


def test_archive_round_trip(spark):
    same = "x" * 200
    rows = [(1, "http://a.b/x", same), (2, "http://a.b/x", same), (2, "http://a.b/x", same), (None, None, same), (3, None, None),
            (4, "http://a.b/\té\n", "é" * 60), (-5, "http://c", "é" * 60), (None, "q", "z"), (1, "http://a.b/x", same),
            (6, "http://[::1", "short"), (7, "http://h", "short"), (8, "http://long", "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(1) for c in ("payload", "digest", "key", "file")})
    got = sorted((tuple(r) for r in warc.archive_round_trip(df).collect()), key=str)
    want = []
    for page, _, text in rows:
        raw = (text or "").encode()
        first = min((p for p, _, t in rows if t == text and p is not None), default=None)
        again = len(raw) >= 100 and first is not None and page != first
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    stored = [r for r in warc.archive_round_trip(df, payload=True).collect() if r.record_type == "response"]
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in stored)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_index_finds_keys_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    lines = spark.createDataFrame([(f"k{i % 4}", i // 8 if i else None, "f", i, 1) for i in range(64)], warc.LINE)
    index = warc.Index(str(tmp_path), warc.index(lines.coalesce(1), f"file://{tmp_path}"))
    for key in ("k0", "k3"):
        for page in range(8):
            want = sorted(r["offset"] for r in lines.where(f"key = '{key}' and page_id = {page}").collect())
            assert sorted(o for _, o, _ in index.find(key, page)) == want
    assert [o for _, o, _ in index.find("k0", None)] == [0]
    assert list(index.find("nothing", 1)) == []


def test_pipeline_stages(spark, labelled, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]
    docs, labels = labelled
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    more = spark.createDataFrame([(9000, "ba do ki lu men ra so ti write to a@b.org now ba do"), (9001, "ba do ki lu men ra so ti write to a@b.org now ba do")],
                                 "doc_id long, text string")
    base = docs.select("doc_id", "text").union(more).withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    rows = base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, corpus_pipeline.written(stage(spark, rows, str(tmp_path)), name)
        assert rows.columns == base.columns
        ids = {r.doc_id for r in rows.collect()}
        assert ids <= {r.doc_id for r in before.collect()}
    truth = {r.doc_id: r for r in labels.collect()}
    for r in rows.collect():
        assert r.text is None or "a@b.org" not in r.text
    kept = [r.doc_id for r in rows.collect() if r.doc_id is not None and r.doc_id < 900]
    assert np.mean([truth[i].toxic == 0 and truth[i].quality == 1 for i in kept]) > 0.97
    assert len(kept) > 0.9 * sum(t.toxic == 0 and t.quality == 1 for i, t in truth.items() if i is not None and i < 900)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
