"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import (
    class_ngram, common, cotrain, langid, mixture, private_spans, simhash, token_frames, url_filter, vector_approx, winnow,
)
from folioframe.llm.queries import URL_RULES, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, score string, key string, word string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from all the hounds of the town"


def rows():
    other = {"copy": "c", "score": "s", "key": "k", "word": "w"}
    base = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "de", "b"),
        (6, "Hund", "de", None), (7, LONG, "en", "a"), (8, "ÉCOLE Straße 😀 naïve " * 5, "fr", "c"), (None, "no id here at all", "en", "a"),
        (None, "another text without an id", None, "a"), (9, "!!! ### 123 456", "en", "c"), (-5, "negative id " * 3, "de", "c"),
        (10, PROSE.replace("dog", "cat"), "en", "a"), (11, "mail a@b.co now", "en", "d"), (12, "1 " * 9_000, "en", "d"),
    ]
    return [(i, t, lang, s, len(t) if t else None, *other.values()) for i, t, lang, s in base]


@pytest.fixture(scope="module")
def docs(spark):
    return common.stored(spark.createDataFrame(rows(), SCHEMA), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return common.stored(spark.createDataFrame([], SCHEMA), "test-none")


def ids(found):
    return sorted((r.doc_id for r in found), key=lambda x: (x is None, x))


ALL = ids(type("R", (), {"doc_id": r[0]}) for r in rows())


def test_op1(docs, none):
    found = class_ngram.language_model(docs).collect()
    assert ids(found) == ALL
    by_id = {r.doc_id: r for r in found}
    assert by_id[3].n_tokens == by_id[4].n_tokens == by_id[5].n_tokens == 1 and by_id[12].n_tokens == 9001
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    assert class_ngram.language_model(none).count() == 0


def test_op1_everything_held_out(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    frame = spark.createDataFrame([(only, "a b")], "doc_id long, text string")
    row = class_ngram.language_model(frame).first()
    assert row.n_tokens == 3 and math.isfinite(row.score)


def test_op1_many_rare_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(class_ngram, "FREQUENT", 3)
    texts = {i: f"a a b c{i % 4} d{i % 7} unique{i}" for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in class_ngram.language_model(frame).collect()}
    counts = Counter(w for i, t in texts.items() if not found[i].held_out for w in [*t.split(), ""])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        own = [*t.split(), ""]
        assert found[i].n_known == sum(counts[w] > 0 for w in own)
        assert math.isclose(found[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)


def test_op2(docs, none, spark, tmp_path):
    found = token_frames.token_frames(docs, tokenizer_file(), place=str(tmp_path)).collect()
    assert ids(found) == ALL
    assert {r.n_tokens for r in found if r.doc_id in (3, 4, 5)} == {1}
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    listing = spark.createDataFrame([(r.doc_id, r.path, r.frame) for r in found if r.doc_id in (2, 7, 9)], "doc_id long, path string, frame long")
    some = token_frames.read_some(listing).collect()
    assert Counter(r.doc_id for r in some) == {2: 2, 7: 1, 9: 1}
    assert {len(r.ids) for r in some if r.doc_id == 7} == {r.n_tokens for r in found if r.doc_id == 7}
    assert token_frames.token_frames(none, tokenizer_file()).count() == 0


def test_op2_pieces_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(2)
    parts = ["a", "It's", "'S", "é", "́", " ", "  ", "\n", "\t", " ", " ", "\x1c", "<|endoftext|>", "<|startoftext|>x", "😀", "İ", "ΑΣ", "ß",
             "12", "!!", "한", "가", "\x00", "x</w>", "Ⅷ", "ﬁ", "\u0085", "ÀÉß", "ñandú.", "x²,", "ª.", "µm", "Ÿ", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    whole = Tokenizer.from_file(tokenizer_file())
    found = token_frames.Encoder(tokenizer_file(), 1).of(texts)
    for text, data in zip(texts, found, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_op2_other_vocabularies_encode_whole_texts():
    from tokenizers import Tokenizer

    assert token_frames.cuts_at_spaces(tokenizer_file()) and not token_frames.cuts_at_spaces(tokenizer_file("byte_bpe_50k.json"))
    texts = ["Two  spaces, and\nlines.", "", None]
    whole = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for text, data in zip(texts, token_frames.Encoder(tokenizer_file("byte_bpe_50k.json"), 1).of(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def test_op2_damage_is_noticed(tmp_path):
    import zstandard

    packer, path = zstandard.ZstdCompressor(write_checksum=True), str(tmp_path / "x.zst")
    plain = [np.arange(n, dtype="<u4").tobytes() for n in (3, 1, 5000)]
    import xxhash

    token_frames.write_file(path, [(i, len(p), xxhash.xxh64_intdigest(p) & 0xFFFFFFFF, packer.compress(p)) for i, p in enumerate(plain)])
    file = token_frames.FrameFile(path)
    assert [file.plain(i) for i in (2, 0, 1)] == [plain[2], plain[0], plain[1]] and file.ids.tolist() == [0, 1, 2]
    with open(path, "rb") as whole, zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True) as reader:
        assert reader.read() == b"".join(plain)
    data = bytearray(open(path, "rb").read())
    data[int(file.starts[1]) + 8] ^= 1
    open(path, "wb").write(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_frames.FrameFile(path).plain(1)


def test_op3(docs, none):
    found = simhash.near_duplicates(docs).collect()
    assert ids(found) == ALL
    blank = {(r.fingerprint, r.component_id) for r in found if r.doc_id in (3, 4, 5)}
    assert blank == {("0" * 16, 3)}
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_op3_chains_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 400, dtype=np.uint64).tolist()
    chain = [values[0]]
    for i in range(60):
        chain.append(chain[-1] ^ (1 << (i % 64)) ^ (1 << ((i * 7 + 1) % 64)))
    ball = [values[1] ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    values = sorted({*values, *chain, *ball})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = common.components(common.stored(simhash.links(frame), "test-links"), "test")
    found = {r.v % (1 << 64): r.root for r in roots.collect()}
    array, part = np.array(values, np.uint64), list(range(len(values)))

    def find(i):
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= 3).tolist():
            a, b = find(i), find(j)
            part[max(a, b)] = min(a, b)
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(find(i), set()).add(v)
    for own in groups.values():
        assert len({found.get(v, v if v < 1 << 63 else v - (1 << 64)) for v in own}) == 1
    assert len(found) == sum(len(g) for g in groups.values() if len(g) > 1)


def test_op3_near_copies_of_the_pipeline(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(3000)]
    texts, groups = [], []
    for g in range(60):
        own = [rng.choice(words) for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 6)):
            changed = list(own)
            for at in rng.sample(range(len(own)), max(1, len(own) // 80)):
                changed[at] = rng.choice(words)
            texts.append(" ".join(changed))
            groups.append(g)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(frame).collect())
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert kept == sorted(set(root))


def test_op3_near_copies_behind_many_nearer_ones(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = random.Random(6)
    base = [f"v{rng.randrange(10**6)}" for _ in range(1000)]

    def changed(words, n, low=0, high=500):
        words = list(words)
        for slot in rng.sample(range(low, high, 5), n):
            words[slot] = f"v{rng.randrange(10**6)}"
        return words

    # Two crowds of near copies whose only link is that of their first and last texts.
    far = changed(base, 20, 500, 1000)
    crowds = [base, *(changed(base, 5) for _ in range(60)), *(changed(far, 5) for _ in range(60)), far]
    chain = [[w + "c" for w in base]]
    for _ in range(100):
        chain.append(changed(chain[-1], 15, 0, 1000))
    texts = [" ".join(t) for t in crowds + chain]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(frame).collect())
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert kept == sorted(set(root))


def test_op3_keep_one(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert ids(kept.collect()) == ids(type("R", (), {"doc_id": i}) for i in (-5, 1, 3, 6, 7, 8, 9, 11, 12, None, None, 10))
    assert simhash.keep_one(none).count() == 0


def test_op4(docs, none):
    mixed = mixture.mix(docs, epochs=50.0)
    assert mixed.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    found = mixed.collect()
    assert {r.doc_id for r in found} <= {r[0] for r in rows()}
    assert mixed.count() == len(found) > 100
    twice = Counter((r.doc_id, r.copy) for r in found)
    assert all(n == (2 if i in (2,) else twice[i, c]) for (i, c), n in twice.items())
    assert mixture.mix(none).count() == 0
    assert mixture.mix(docs, weights={"nowhere": 1.0}).count() == 0


def test_op4_follows_the_weights(spark):
    frame = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("source"))
    n = Counter(r.source for r in mixture.mix(frame, weights={"hot": 1.0, "s1": 1.0, "s2": 2.0}, epochs=10.0).select("source").collect())
    assert set(n) == {"hot", "s1", "s2"}
    for source, share in (("hot", 0.25), ("s1", 0.25), ("s2", 0.5)):
        assert abs(n[source] / 60_000 - share) < 0.01


def test_op5(docs, none):
    found = private_spans.find(docs).collect()
    assert ids(found) == ALL
    assert {r.doc_id: r.spans for r in found}[11] == "email:5:11"
    assert private_spans.find(none).count() == 0


def test_op6(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(0, 0.2, 8).round(2).tolist()) for i in range(450)]
    vectors += [(i, vectors[7][1]) for i in range(450, 700)]
    odd = [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [0.1] * 8), (1100, []), (1200, [0.5] * 5),
           (1201, [0.25] * 5), (1, vectors[1][1])]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    found = vector_approx.top_k(frame, 10, segment=128)
    whole = {}
    for i, x in vectors + [(1200, [0.5] * 5), (1201, [0.25] * 5), (1, vectors[1][1])]:
        whole.setdefault(len(x), []).append((i, np.floor(1024 * np.array(x, np.float32).astype(float)).astype(int)))
    want = set()
    for group in whole.values():
        for q, x in group:
            if q % 100 == 0:
                scores = sorted(((-int(x @ y), i) for i, y in group if i != q))[:10]
                want |= {(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)}
    assert {tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert vector_approx.top_k(frame.limit(0), 10).count() == 0


def test_op7(docs, none):
    model = langid.train(docs)
    found = langid.predict(docs, model)
    assert set(found.columns) == {*docs.columns, "lang_pred"} and ids(found.collect()) == ALL
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[3].lang_pred == by_id[4].lang_pred == by_id[9].lang_pred == "und"
    assert by_id[8].lang_pred == "fr" and by_id[1].lang_pred == "en"
    assert langid.predict(none, model).count() == 0
    untaught = langid.predict(docs, langid.train(none)).collect()
    assert {r.lang_pred for r in untaught} == {"und"} and {r.score for r in untaught} == {0.0}


def test_op7_backs_off_to_shorter_grams(spark):
    frame = spark.createDataFrame([(1, "Wasser wasser Schiff", "de"), (2, "water water ship", "en")], "doc_id long, text string, lang string")
    model = langid.train(frame)
    told = langid.Predictor(model).of
    assert told("wasserschiff")[0] == "de" and told("waters ships")[0] == "en"
    assert told("ß")[0] in ("de", "en")


def brute(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = words(text), set(), set()
    for item, said in items:
        asked = words(said)
        n = min(window, len(asked))
        for k in range(len(asked) - n + 1 if asked else 0):
            for i in range(len(own) - n + 1):
                if own[i:i + n] == asked[k:k + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(own), len(hit), len(found)


def test_op8(spark, none):
    rng = random.Random(7)
    words = ["a", "b", "The", "öl", "x9", "Zug"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((1, 2, 4, 5, 9, 10, 11, 14, 30, 12, 0))]
    items += [(50, None), (51, items[7][1]), (52, "!?")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [f"{rng.choice(words)}, {items[k][1]}-{rng.choice(words)}" for k in (5, 6, 7, 8, 9) for _ in range(3)] + [None, "", "?", items[8][1] * 200]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, mark string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for asked in (items, [i for i in items if len((i[1] or "").split()) >= 10]):
        frame = spark.createDataFrame(asked, "item_id long, text string")
        found = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in winnow.decontaminate(docs, frame).collect())
        want = Counter((i if i % 9 else None, *(m := brute(t, asked)), m[1] > 0) for i, t in enumerate(texts))
        assert found == want
    long_items = bench.filter("item_id BETWEEN 5 AND 9")
    kept = winnow.clean(docs, long_items)
    asked = [i for i in items if 5 <= i[0] <= 9]
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for t in texts if not brute(t, asked)[1])
    assert winnow.decontaminate(none, bench).count() == 0
    assert winnow.decontaminate(docs, bench.limit(0)).filter("contaminated OR n_hit > 0").count() == 0


def test_op9(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    found = cotrain.quality(docs, labels).collect()
    assert ids(found) == ALL and all(0 <= r.score <= 1 for r in found)
    assert cotrain.quality(none, labels).count() == 0
    assert cotrain.quality(docs, labels.limit(0)).count() == len(ALL)


def test_op9_views_teach_each_other():
    rng = np.random.default_rng(5)
    n = 3000
    y = rng.integers(0, 2, n)
    text = np.stack([y + rng.normal(0, 0.6, n), rng.normal(0, 1, n), np.ones(n)], axis=1)
    meta = np.stack([y + rng.normal(0, 0.6, n), rng.normal(0, 1, n), np.ones(n)], axis=1)
    few, rest = slice(0, 60), slice(60, 2000)
    model = cotrain.co_train((text[few], meta[few]), y[few], (text[rest], meta[rest]), each=200)
    one, two, both = model.scores((text[2000:], meta[2000:]))
    right = lambda p: ((p > 0.5) == y[2000:]).mean()
    assert right(one) > 0.72 and right(two) > 0.72 and right(both) > max(right(one), right(two)) - 0.01


def test_op10(spark):
    urls = [None, "", "no scheme", "http://", "https://Example.COM/en/x", "http://www.example.com/en/x", "http://a.net/es/1", "http://a.net/fr", "http://net/fr/",
            "http://xnet/fr/", "http://b.com", "http://b.com/?x=1", "http://bad.org/p/?b=2&a=1&utm_x=3#t", "https://bad.org/p?a=1&b=2", "http://bad.org/q", "http://bad.org/q"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://a.com/", "x")], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.org/p?a=1&b=2",), ("bad.org/p?a=1&b=2",), (None,), ("other.org/z",)], "key string")
    found = {r.page_id: r for r in url_filter.judge(pages, URL_RULES, listed).collect()}
    assert len(found) == len(urls) + 1
    assert [found[i].rule for i in range(len(urls))] == [
        None, None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", None, "net/fr/", None, None, "com/", None, None, None, None]
    assert [i for i in range(len(urls)) if found[i].verdict == "block"] == [4, 6, 8, 12, 13]
    assert (found[0].host, found[0].path, found[3].host, found[12].path) == ("", "", "", "/p/")
    assert url_filter.judge(pages.limit(0), URL_RULES, listed).count() == 0
    assert url_filter.judge(pages, URL_RULES, listed.limit(0)).filter("verdict = 'block'").count() == 3


def test_op10_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("h.org/"), F.col("id").cast("string")).alias("key"))
    asked = spark.range(20_000).select(F.concat(F.lit("h.org/"), F.col("id").cast("string")).alias("key"))
    assert url_filter.listed_urls(asked, keys).count() == 5000
