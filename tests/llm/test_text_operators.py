"""Packing, BPE, personal data, SimHash: exact against the library or brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlane.llm import bpe, packing, pii, simhash
from flowlane.llm.catalog import BYTE_VOCABULARY, WORD_VOCABULARY
from flowlane.llm.words import Encoder

ODD = ["", " ", "  a  b ", "a\n\n b\t\tc", "it's I'LL don't", "x  \n", "1234 567", "İstanbul ŒUVRE ﬁ", "<|endoftext|> hi",
       "日本語 テキスト", "a b", "naïve café—“q”", "$$$ ### 12a3b", "ΑΣ Σ", "é", " 's 't", "a" * 3000, "ab " * 2000,
       "!!!???...;;;", "a\r\nb", "\x00\x01", "👩‍👩‍👧 ok"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, odd and long texts, repeated rows, and columns whose names clash."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "some text"), (5, ODD[5]), (5, ODD[5]), (101, "w " * 9000),
                                                 (None, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string")
            .withColumns({c: F.lit("x") for c in ("ids", "fp", "node", "score", "length", "spans", "component_id", "left")}))


@pytest.mark.parametrize("path", [WORD_VOCABULARY, BYTE_VOCABULARY])
def test_ids_equal_the_library(path):
    enc, library = Encoder(path, limit=50), Tokenizer.from_file(path)
    for t in [*ODD, " ".join(ODD)]:
        assert enc.ids(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_transducer_holds_its_words_only(tmp_path):
    words = sorted({f"{a}{b}{c}" for a in ("", "re", "un") for b in ("do", "tie") for c in ("", "s", "ing")})
    bpe.Lexicon.write(str(tmp_path / "l"), words, [w.encode() * 2 for w in words])
    lexicon = bpe.Lexicon(str(tmp_path / "l"))
    numbers = lexicon.look_up([w.encode() for w in words])
    assert numbers.tolist() == list(range(len(words)))
    assert lexicon.ids_of(numbers) == [w.encode() * 2 for w in words]
    assert (lexicon.look_up([b"", b"re", b"does", b"doings", b"xdo"]) == -1).all()
    # prefixes and suffixes are shared: far fewer states than letters
    assert len(lexicon.final) < 20 < sum(map(len, words))


def test_bpe_round_trip(spark, docs):
    library = Tokenizer.from_file(BYTE_VOCABULARY)
    got = bpe.encode(docs, BYTE_VOCABULARY).withColumn("back", bpe.decoded(F.col("ids"), BYTE_VOCABULARY)).collect()
    want = [(r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in docs.collect()]
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.back for r in got) == sorted(
        library.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False) for _, i in want)
    assert bpe.encode(docs.limit(0), BYTE_VOCABULARY).count() == 0


def test_best_fill_is_the_best_subset():
    rng = np.random.default_rng(3)
    for _ in range(200):
        items = rng.integers(1, 30, rng.integers(1, 9)).tolist()
        counts = {n: items.count(n) for n in items}
        capacity = int(rng.integers(1, 90))
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        chosen = packing.best_fill(sorted(counts), counts, capacity)
        assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= capacity)
        assert all(k <= counts[n] for n, k in chosen)


def test_packing_covers_every_id_once(spark, docs):
    library = Tokenizer.from_file(WORD_VOCABULARY)
    window = 64
    got = packing.pack_documents(docs.repartition(3), WORD_VOCABULARY, window=window, pool_items=8, fan_in=2).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4"))
    for doc, copies in texts.items():
        ids = copies[0]
        mine = [r for r in got if r.doc_id == doc]
        assert sum(r.length for r in mine) == sum(map(len, copies))
        if doc is not None:
            for r in mine:
                assert r.doc_tokens == len(ids)
                assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    assert packing.pack_documents(docs.limit(0), WORD_VOCABULARY).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


PERSONAL = ["a@b.com_x@y.z a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111 1111 1111 x 4111-1111-1111-1112",
            "+49 (30) 123-4567 89 +1", "ä😀 x@y.de, iban GB82 WEST 1234 5698 7654 32 bank", "", "@@@", "a" * 20000,
            "a.b@c.d " * 1500, "1" * 20000, "+1" + "(" * 20000, None, "x@" + "a." * 5000 + "b",
            "+1 (826) 555-4081 190.137.223.204", "GB82 WEST 1234 5698 7654 33"]


def test_personal_data_spans(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)) + [(None, "a@b.c"), (0, PERSONAL[0])], "doc_id long, text string")
    df = df.withColumns({"found": F.lit(1), "n_email": F.lit("x"), "kind": F.lit(None).cast("int")})
    got = pii.find(df).collect()
    want = []
    for r in df.collect():
        spans = plain_spans(r.text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want.append((r.doc_id, *[sum(s[2] == k for s in spans) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    spans = {r.doc_id: (r.spans, r.scores) for r in got}
    assert spans[4] == ("email:3:9,iban:16:43", "0.9,1.0")     # mod-97 holds, and a word nearby
    assert spans[14][0] == ""                                  # mod-97 fails
    assert pii.find(df.limit(0)).count() == 0


def test_words_on_either_side_raise_the_score(spark):
    far = " " + "x " * 30
    texts = {"call +1 826 555 4081": "0.8", "+1 826 555 4081 (phone)": "0.8", "+1 826 555 4081": "0.6",
             f"phone{far}+1 826 555 4081{far}phone": "0.6",
             "contact a@b.co or c@d.eu": "1.0,1.0",      # over the match before
             "a@b.co, c@d.eu (mail)": "1.0,1.0",         # over the match after
             "": ""}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.scores for r in pii.find(df).collect()} == dict(enumerate(texts.values()))


def test_redaction_leaves_no_span(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string").withColumns(
        {"n_chars": F.length("text"), "__x__": F.lit(1)})
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    for i, text in enumerate(PERSONAL):
        assert not plain_spans(got[i].text)
        if not plain_spans(text) and i != 4:
            assert got[i].text == text
        assert got[i].n_chars == (None if text is None else len(got[i].text))
    assert got[4].text == "ä😀 [EMAIL], iban [IBAN] bank"
    assert pii.redact(df).columns == df.columns


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + n]).encode(), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, near):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(values))]


def test_simhash_classes(spark, docs):
    base = "one two three four five six seven eight nine ten eleven twelve " * 40
    more = spark.createDataFrame([(200 + i, base + " ".join(["end"] * i)) for i in range(6)], "doc_id long, text string")
    df = docs.select("doc_id", "text", "fp").unionByName(more.withColumn("fp", F.lit("x")))
    rows = df.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    comp = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {c: min((r.doc_id for r, k in zip(rows, comp, strict=True) if k == c and r.doc_id is not None), default=None)
             for c in set(comp)}
    want = sorted(((r.doc_id, f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, comp, strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(comp))
    assert {r.doc_id for r in kept.collect()} >= {x for x in least.values() if x is not None}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_no_class_is_lost_when_row_hashes_clash(spark, docs, monkeypatch):
    """Every row has the same hash: still one row of each class stays, all columns with it."""
    df = docs.select("doc_id", "text").withColumns({c: F.lit("mine") for c in ("fp", "row_hash", "its_row", "its_fp", "redacted", "found_ip")})
    want = simhash.keep_one(df).select("doc_id", "text").collect()
    monkeypatch.setattr(simhash, "row_hash", lambda columns: F.lit(7).cast("long"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.where("row_hash = 'mine' and its_fp = 'mine'").count() == len(want)
    classes = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert {r.doc_id for r in kept.collect()} >= classes - {None} and len(want) >= len(classes)
    masked = pii.redact(df)
    assert masked.columns == df.columns and masked.where("redacted = 'mine' and found_ip = 'mine'").count() == df.count()


@pytest.mark.parametrize("bucket", [4096, 4])
def test_simhash_links_every_class(spark, bucket):
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(0, 2 ** 63, 40)]
    for x in list(values):
        for _ in range(5):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            values.append(x)
    # a crowd that shares all but its last bits
    values += [values[0] & ~0xFFF | int(k) for k in rng.integers(0, 4096, 150)]
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    edges = simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, bucket).collect()
    want = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    place = {v: i for i, v in enumerate(signed)}
    links = {tuple(sorted((place[e.a], place[e.b]))) for e in edges}
    got = plain_components(list(range(len(values))), lambda a, b: (b, a) in links or (a, b) in links)
    assert got == want


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(8)
    values = np.unique(rng.integers(0, 2 ** 14, 900).astype(np.uint64))
    index = simhash.GrayIndex(values)
    got = {tuple(sorted((int(index.values[a]), int(index.values[b])))) for i, j in index.pairs(2) for a, b in zip(i, j, strict=True)}
    want = {(int(a), int(b)) for a in values for b in values if a < b and int(a ^ b).bit_count() <= 2}
    assert got == want
