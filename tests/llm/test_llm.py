"""The training-data operators against brute force, round trips and their defined results for odd input."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies
from pyspark.sql import functions as F

from recallgrid.llm import chat, decontaminate, encode, licenses, ngram_join, packing, quality, tiff, tokenfile, toxicity, urls
from recallgrid.llm.components import components
from recallgrid.llm.queries import ORACLES, QUERIES, held_out, tokenizer_path
from recallgrid.llm.textscan import Words, slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def corpus(seed=7, n=60):
    """Documents with copies, near copies, nulls, empties, a long text and non-ASCII words."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["añb", "the", "oße", "x1", "Term", "ünd"]) + rng.choice("abcdefgh") * rng.randint(0, 3)
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 6):
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts += [texts[i], " ".join(w), texts[i].upper()]
    return [*texts, None, "", "  \n", "Straße! " * 9000, "one", "ONE."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(corpus())], DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_shingles_match_plain_python():
    texts = [t or "" for t in corpus()]
    seen = {}
    for low, high, data, at in slices(pa.array(texts), 500):
        w = Words(data, at)
        body, bounds = w.normalised()
        hashes, first = w.shingles(5)
        for i in range(high - low):
            own = words(texts[low + i])
            assert body[bounds[i] : bounds[i + 1]].decode().split() == own
            grams = [tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))] if own else []
            assert first[i + 1] - first[i] == len(grams)
            for g, h in zip(grams, hashes[first[i] : first[i + 1]].tolist(), strict=True):
                assert seen.setdefault(g, h) == h
    assert len(set(seen.values())) == len(seen)


def brute_links(texts, width=5, least=0.8):
    sets = [frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if (w := words(t)) else frozenset() for t in texts]
    linked = lambda a, b: a == b or (a and b and len(a & b) >= least * len(a | b) - 1e-9)
    n = [sum(i != j and bool(linked(a, b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if linked(a, sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return n, root


@pytest.mark.parametrize("chunk", [512, 3])
def test_similarity_join_equals_brute_force(spark, docs, chunk):
    texts = corpus()
    n, root = brute_links(texts)
    got = {r.doc_id: r for r in ngram_join.similarity_join(docs, settings=ngram_join.JoinSettings(chunk=chunk)).collect()}
    assert [got[i].n_links for i in range(len(texts))] == n
    assert [got[i].class_id for i in range(len(texts))] == root


def test_similarity_join_odd_input(spark, docs, empty):
    assert ngram_join.similarity_join(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("bands", F.lit("x"))
    got = sorted((str(r.doc_id), r.class_id, r.n_copies, r.n_links) for r in ngram_join.similarity_join(odd).collect())
    assert got == [("1", 1, 3, 2), ("1", 1, 3, 2), ("2", 2, 2, 1), ("3", 2, 2, 1), ("None", 1, 3, 2)]
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(brute_links(corpus())[1]))


def test_similarity_join_refines_large_groups(spark, docs):
    texts = corpus()
    n, root = brute_links(texts)
    for side in (1024, 3):
        got = {r.doc_id: r for r in ngram_join.similarity_join(docs, settings=ngram_join.JoinSettings(refine=1, side=side, chunk=4)).collect()}
        assert [got[i].n_links for i in range(len(texts))] == n and [got[i].class_id for i in range(len(texts))] == root


def test_chains_of_slightly_alike_texts_fall_apart(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    chain = [[rng.choice(vocabulary) for _ in range(120)]]
    for _ in range(600):  # each has a similarity of about 0.55 to the one before
        at = rng.randrange(4)
        chain.append([w if (k // 30) != at else rng.choice(vocabulary) for k, w in enumerate(chain[-1])])
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(chain)], "id long, text string")
    s = ngram_join.JoinSettings(refine=16)
    signed = rows.select("id", F.lit("").alias("raw"), "text").mapInArrow(ngram_join._sign(s), "id long, raw string, node long, check long, sign binary")
    _, nodes = ngram_join._nodes(signed)
    before = ngram_join.candidate_groups(nodes, ngram_join.JoinSettings(refine=10**6)).groupBy("component").count().agg(F.max("count")).first()[0]
    after = ngram_join.candidate_groups(nodes, s).groupBy("component").count().agg(F.max("count")).first()[0]
    assert before > 16 and (after or 0) <= 16


def test_node_numbers_that_clash_stay_apart(spark, docs):
    texts = corpus()
    n, root = brute_links(texts)
    got = {r.doc_id: r for r in ngram_join.similarity_join(docs, settings=ngram_join.JoinSettings(key_bits=3)).collect()}
    assert [got[i].n_links for i in range(len(texts))] == n and [got[i].class_id for i in range(len(texts))] == root


def test_one_row_of_each_class_stays(spark):
    a, near, b = "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n", "one two three four five six"
    odd = spark.createDataFrame([(1, a, 5), (1, a, 5), (None, near, 6), (2, b, 7), (2, a.upper(), 8), (None, "only here", 9), (None, "only here", 9), (4, None, 1), (4, "", 2)], "doc_id long, text string, n long")
    kept = sorted((str(r.doc_id), r.text or "") for r in ngram_join.one_of_each(odd).collect())
    assert [k for k in kept if k[1] not in (a, "")] == [("2", b), ("None", "only here")]
    assert sum(k[1] == a for k in kept) == 1 and sum(k[1] == "" for k in kept) == 1 and len(kept) == 4


def test_recall_of_the_join_over_whole_documents(spark):
    """Every pair of similarity 0.8 or more among all documents of the middle table, by an inverted index in plain Python."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for r in rows if (w := words(r.text))}
    index = {}
    for d, grams in sets.items():
        for g in grams:
            index.setdefault(g, []).append(d)
    common = {}
    for ds in index.values():
        for x, y in itertools.combinations(ds, 2):
            common[x, y] = common.get((x, y), 0) + 1
    links = {d: 0 for d in sets}
    for (x, y), c in common.items():
        if c >= 0.8 * (len(sets[x]) + len(sets[y]) - c) - 1e-9:
            links[x] += 1
            links[y] += 1
    got = {r.doc_id: r.n_links for r in ngram_join.similarity_join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert {d: got[d] for d in links} == links


def test_posterior_bound_and_components(spark):
    least = ngram_join.keep_at_least(ngram_join.JoinSettings())
    assert least == sorted(least) and least[-1] < 0.8 * 150
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 60), (7, 7), (60, 100)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).select("node", "component").collect())
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in (50, 60, 100)}) == 1 and got[0] != got[50]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def labelled(spark, make, n=400, seed=3):
    rng = random.Random(seed)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "more"]) + rng.choice("xyz") for _ in range(rng.randint(20, 60)))
    rows = [(i, make(clean(), rng) if i % 4 == 0 else clean(), int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], DOCS), spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_quality_separates_held_out_documents(spark, empty):
    data, labels = labelled(spark, lambda t, r: " ".join(w + "!!" for w in t.upper().split()))
    weights = quality.train(data, labels)
    got = quality.score(data, weights).join(labels, "doc_id").where(held_out()).select("quality_score", "quality").collect()
    assert all((r.quality_score >= 0.3) == bool(r.quality) for r in got)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").withColumn("quality_score", F.lit("x"))
    assert len({r.quality_score for r in quality.score(odd, weights).collect()}) == 1
    nothing = quality.train(empty, labels.limit(0))
    assert not nothing.any() and quality.score(empty, nothing).count() == 0


def test_equal_texts_get_equal_scores_and_long_ones_are_scored_whole(spark):
    data, labels = labelled(spark, lambda t, r: t.upper())
    weights = quality.train(data, labels)
    long = "alphax BETAY " * 60_000
    rows = [(i, t) for i, t in enumerate(["alphax betay!"] * 40 + ["", long, "gammaz", "alphax betay!", long])]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), weights).collect()
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add(r.quality_score)
    assert all(len(v) == 1 for v in by.values()) and len(by) == 4
    for text, (score,) in ((t, tuple(v)) for t, v in by.items()):
        raw = np.frombuffer(text.encode(), np.uint8)
        kinds, _, counts = quality.features(raw, np.array([0, len(raw)]), 18)
        total = sum(weights.astype(np.float32).astype(float)[k] for k in kinds.reshape(-1)) if counts[0] else 0.0
        x = total * 12.0 / max(counts[0], 1) + np.float32(weights[-1])
        assert abs(score - 1 / (1 + np.exp(-x))) < 1e-6


def test_training_takes_a_bounded_amount_of_text(spark):
    data, labels = labelled(spark, lambda t, r: t.upper())
    few = quality.train(data, labels, settings=quality.QualitySettings(sample_bytes=1))
    assert 0 < np.count_nonzero(few) < np.count_nonzero(quality.train(data, labels)) or not few[:-1].any()


def test_ftrl_equals_a_plain_version():
    s = quality.QualitySettings(bits=6)
    model, rng = quality.Ftrl(s), random.Random(1)
    z, n = [0.0] * 65, [0.0] * 65
    for _ in range(200):
        at = np.array(sorted(rng.sample(range(65), 5)))
        values, label = np.array([rng.random() for _ in at]), rng.randint(0, 1)
        w = [0.0 if abs(z[i]) <= s.l1 else -(z[i] - (s.l1 if z[i] > 0 else -s.l1)) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, values, strict=True))))
        for i, v, wi in zip(at, values, w, strict=True):
            g = (p - label) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * wi
            n[i] += g * g
        model.learn(at, values, label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_quality_never_learns_from_held_out_rows(spark):
    data, labels = labelled(spark, lambda t, r: t.upper())
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train(data, labels), quality.train(data, flipped))


def test_toxicity_learns_words_and_folds(spark, empty):
    data, labels = labelled(spark, lambda t, r: t + " " + r.choice(["zorkel", "blinfar", "Zorkelish"]) + " end")
    lexicon = toxicity.learn(data, labels)
    assert "=zorkel" in lexicon.entries
    got = toxicity.score(data, lexicon).join(labels, "doc_id").where(held_out()).select("toxicity_score", "toxic").collect()
    assert all((r.toxicity_score >= 0.5) == bool(r.toxic) for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a Z0RKEL b"), (4, "zоrkеl with look-alikes"), (5, "blinf@r")], "doc_id long, text string").withColumn("total", F.lit(1))
    score = {r.doc_id: r.toxicity_score for r in toxicity.score(odd, lexicon).collect()}
    assert score[1] == score[2] < 0.5 and min(score[3], score[4], score[5]) > 0.5
    bare = toxicity.learn(empty, labels.limit(0))
    assert toxicity.score(empty, bare).count() == 0


def test_folding():
    assert toxicity.folded("IdIoT 1d10t i\u0301diot \uff49\uff44\uff49\uff4f\uff54 \U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d idi\u200bot \u0456di\u043et") == " " + "idiot " * 7
    assert toxicity.folded("in 2015, 100 items; b4d") == " in items bad "
    assert toxicity.folded("") == toxicity.folded("12 34!") == "  "


def test_evidence_equals_a_plain_scan():
    rng = random.Random(9)
    lexicon = toxicity.Lexicon({"=bad": 2.0, "^wor": 3.0, "=worse": 5.0, "=ill": 1.0}, exceptions=("bad luck", "no worse"))
    matcher = toxicity.Matcher(lexicon)
    for _ in range(300):
        own = [rng.choice(["bad", "worse", "wor", "word", "ill", "luck", "no", "fine"]) for _ in range(rng.randint(0, 12))]
        total = hits = 0
        for k, w in enumerate(own):
            excused = any(own[a : a + 2] in (["bad", "luck"], ["no", "worse"]) for a in (k - 1, k) if a >= 0)
            weight = max([v for e, v in lexicon.entries.items() if (e[0] == "=" and e[1:] == w) or (e[0] == "^" and w.startswith(e[1:]))], default=0)
            if weight and not excused:
                total, hits = total + weight, hits + 1
        assert matcher.evidence(" ".join(own)) == (total, hits, len(own))


def test_toxicity_learns_exceptions_and_scores_long_texts(spark):
    data, labels = labelled(spark, lambda t, r: t + " zorkel " + r.choice(["one", "two"]))
    clean = spark.createDataFrame([(5000 + i, f"some zorkel hotel text number{chr(97 + i % 26)}", "en", "s", 0) for i in range(12)], DOCS)
    more = spark.createDataFrame([(5000 + i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(data.unionByName(clean), labels.unionByName(more))
    assert "zorkel hotel" in lexicon.exceptions
    rows = [(1, "a zorkel hotel"), (2, "a zorkel"), (2, "a zorkel"), (3, "alphax " * 50_000 + "zorkel " * 40_000)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), lexicon).collect()}
    assert got[1].matches == 0 and got[2].matches == 1 and got[3].matches == 40_000 and got[3].toxicity_score > 0.5


def test_exception_phrases_take_matches_away():
    m = toxicity.Matcher(toxicity.Lexicon({"=trash": 4.0, "^sc": 2.0}, exceptions=("trash can",)))
    assert m.evidence("the trash can is full") == (0.0, 0, 5)
    assert m.evidence("trash scorn ascetic") == (6.0, 2, 3)


def test_decontamination_equals_brute_force(spark, docs, empty):
    texts = corpus()
    items = [(str(i), " ".join((texts[i] or "").split()[:n])) for i, n in ((0, 14), (1, 10), (2, 5), (3, 30), (5, 1))] + [("9", ""), ("10", texts[0])]
    found = {r.doc_id: r for r in decontaminate.scan(docs, items).collect()}
    for i, t in enumerate(texts):
        own, hit, names = words(t), set(), set()
        for name, text in items:
            w = words(text)
            for k in range(max(1, len(w) - 9) if w else 0):
                win = w[k : k + 10]
                for p in range(len(own) - len(win) + 1):
                    if own[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        names.add(name)
        r = found[i]
        assert (r.n_words, sum(h.word_to - h.word_from for h in r.hits), r["items"]) == (len(own), len(hit), sorted(names))
        for h in r.hits:
            assert words((t or "")[h.char_from : h.char_to]) == own[h.word_from : h.word_to]
    assert decontaminate.scan(empty, items).count() == 0 and decontaminate.scan(docs, []).where("size(hits) > 0").count() == 0


def test_the_join_for_large_benchmarks_equals_the_automaton(spark, docs, empty):
    texts = corpus()
    items = [(i, " ".join((texts[i] or "").split()[:n])) for i, n in ((0, 14), (1, 10), (2, 5), (3, 30), (5, 1))] + [(9, ""), (10, texts[0]), (11, None), (None, texts[7]), (10, texts[0]), (12, "straße straße")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    odd = docs.unionByName(docs.where("doc_id in (0, 7)")).withColumns({"hits": F.lit("x"), "_key": F.lit("y"), "n_words": F.lit(0)}).drop("_key")
    plain = lambda df: sorted(map(str, df.select("doc_id", "text", "n_words", "hits", "items").collect()))
    one = plain(decontaminate.decontaminate(odd, benchmark))
    for bits in (27, 17):  # few bits let more through the map; the join is exact
        assert plain(decontaminate.decontaminate(odd, benchmark, settings=decontaminate.WindowSettings(automaton_bytes=0, map_bits=bits))) == one
    assert any("word_from" in r for r in one)
    big = decontaminate.WindowSettings(automaton_bytes=0)
    assert decontaminate.decontaminate(empty, benchmark, settings=big).count() == 0
    assert decontaminate.scan_joined(docs, benchmark.limit(0).selectExpr("string(item_id) name", "text"), settings=big).where("size(hits) > 0").count() == 0


def test_decontamination_keeps_wide_spaces_and_items_without_id(spark):
    plain = [f"w{i}" for i in range(14)]
    odd = [" ".join([*plain[:6], f"france{x}? la", *plain[6:]]) for x in ("\u00a0", "\u202f", "\u3000", "\u0085")]
    texts = [*odd, "a passage without any id", "other words"]
    benchmark = spark.createDataFrame([*enumerate(odd), (None, texts[4]), (9, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.scan(docs, decontaminate.benchmark_items(benchmark)).collect()}
    for i, t in enumerate(odd):
        assert sum(h.word_to - h.word_from for h in found[i].hits) == len(words(t)) and found[i]["items"] == [str(i)]
    assert sum(h.word_to - h.word_from for h in found[4].hits) == 5 and found[4]["items"] == []
    assert not found[5].hits
    assert decontaminate.windows(f"a{chr(0x3000)}b c", 2) == [f" a{chr(0x3000)}b c "]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path(), random.Random(0)
    whole, coder = Tokenizer.from_file(path), encode.Encoder(path, most_bytes=40_000)
    texts = [t or "" for t in corpus()] + ["é!!a", "don't 's!'s 12ab34", "<|endoftext|> hi", "ΑΣ Σ!", "a\x0bb\x85c\u2003d"]
    texts += ["".join(rng.choice("aé'!€ 1Ⅷ̸́=<sre\nZ") for _ in range(40)) for _ in range(600)]
    got = [i for _, part in encode.text_slices(pa.array(texts), 3000) for i in coder.many(part)]
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_elias_fano_and_blocks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 257, 3000):
        values = np.sort(rng.integers(0, 10**7, n))
        ef, _ = tokenfile.EliasFano.load(memoryview(tokenfile.EliasFano.build(values).dump()), 0)
        assert ef.all().tolist() == values.tolist()
        assert all(ef.select(i) == values[i] for i in range(0, n, max(1, n // 50)))
        assert len(ef.dump()) < n * 5 + 64
    counts = np.array([3, 1, 5])
    block = tokenfile.Block(tokenfile.dump_block(np.array([-4, 7, 7]), counts, np.arange(9, dtype="<u2").tobytes(), 2))
    assert (block.docs.all() + block.base).tolist() == [-4, 7, 7] and block.document(2).tolist() == [4, 5, 6, 7, 8] and block.document(0).tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        tokenfile.Block(b"nothing here")


def expected_ids(text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_token_files_round_trip(spark, docs, empty):
    blocks = tokenfile.write_token_file(docs, tokenizer_path(), 1, block_ids=500)
    got = {r.doc_id: r for r in tokenfile.read_token_file(blocks).collect()}
    start = 0
    for i, t in enumerate(corpus()):
        ids = expected_ids(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.read_token_file(tokenfile.write_token_file(empty, tokenizer_path(), 1)).count() == 0


def test_token_files_odd_input(spark):
    odd = spark.createDataFrame([(5, "b b"), (5, "a"), (None, "left out"), (-3, None), (5, "a"), (7, "the " * 30_000)], "doc_id long, text string").withColumns({"part": F.lit("x"), "payload": F.lit(1)})
    got = sorted(tokenfile.read_token_file(tokenfile.write_token_file(odd, tokenizer_path(), 1)).collect(), key=lambda r: r.start)
    order = [(-3, ""), (5, "a"), (5, "a"), (5, "b b"), (7, "the " * 30_000)]
    start = 0
    for r, (number, text) in zip(got, order, strict=True):
        ids = expected_ids(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (number, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_whole_gapless_and_tight(spark, docs, empty):
    rows = packing.pack(packing.cut_pieces(docs, tokenizer_path(), 1, 256), 256).collect()
    used = check_packing(rows, 256)
    total = 0
    for i, t in enumerate(corpus()):
        ids = expected_ids(t)
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == [(k, min(256, len(ids) - k)) for k in range(0, len(ids), 256)]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[k : k + 256].tobytes()) for k in range(0, len(ids), 256)]
        total += len(ids)
    assert sum(r.length for r in rows) == total
    lengths = [r.length for r in rows]
    assert used <= packing.waste_bound({l: lengths.count(l) for l in lengths}, 256) + 1
    assert packing.pack(packing.cut_pieces(empty, tokenizer_path(), 1, 256), 256).count() == 0


def fewest(lengths, capacity):
    """Exact number of bins by trying every bin for every piece."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in sorted(set(range(len(bins))), key=lambda k: bins[k]):
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng, better = random.Random(5), 0
    for _ in range(150):
        lengths = [rng.randint(15, 70) for _ in range(rng.randint(1, 9))]
        counts = {l: lengths.count(l) for l in lengths}
        plan, proven = packing.bin_completion(counts, 100)
        assert proven
        used = {}
        for pattern, times in plan:
            assert sum(l * n for l, n in pattern) <= 100
            for l, n in pattern:
                used[l] = used.get(l, 0) + n * times
        assert used == counts
        assert packing.waste_bound(counts, 100) <= packing.sequences(plan) == fewest(lengths, 100)
        better += packing.sequences(plan) < packing.sequences(packing.best_fit(counts, 100))
    assert packing.bin_completion({}, 100) == ([], True)
    counts = {44: 2, 24: 2, 22: 2, 21: 1, 17: 2, 8: 3, 6: 3}  # best fit needs four sequences of 100 here, three are enough
    assert packing.sequences(packing.bin_completion(counts, 100)[0]) == packing.waste_bound(counts, 100)
    hard = {23: 1, 28: 2, 38: 1, 41: 1, 13: 2, 10: 1}  # best fit needs three, the search finds two
    assert packing.sequences(packing.best_fit(hard, 100)) == 3 and packing.sequences(packing.bin_completion(hard, 100)[0]) == 2
    assert packing.bin_completion(hard, 100, nodes=0) == (packing.best_fit(hard, 100), False)
    assert better


def test_fillings_are_all_undominated_ones_by_waste():
    counts = {40: 1, 30: 2, 25: 1, 20: 2, 7: 3}
    got = list(packing.fillings(counts, 40, 100, 60))
    free = [dict(zip((30, 25, 20, 7), n, strict=True)) for n in itertools.product(range(3), range(2), range(3), range(4))]
    best = []
    for x in free:
        waste = 60 - sum(l * n for l, n in x.items())
        more = {30: 2, 25: 1, 20: 2, 7: 3}
        if waste < 0 or any(more[l] > x[l] and (l <= waste or any(n and c < l <= c + waste for c, n in x.items())) for l in more):
            continue
        best.append(((40, 1), *((l, n) for l, n in x.items() if n)))
    assert sorted(got) == sorted(best)
    wastes = [100 - sum(l * n for l, n in p) for p in got]
    assert wastes == sorted(wastes)


def test_the_packing_query_beats_best_fit(spark, tmp_path):
    lengths = [985, 174, 1297, 1640, 2415, 36, 1175, 470]
    assert packing.sequences(packing.best_fit({l: 1 for l in lengths}, 4096)) == 3
    rows = [(i, "the " * (l - 1)) for i, l in enumerate(lengths)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op10_packing"](spark, str(tmp_path)).collect()
    assert sorted(r.length for r in got) == sorted(lengths) and check_packing(got, 4096) == 2 and all(r.proven for r in got)


def test_packing_odd_input(spark):
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, ""), (4, "a b c " * 200)], "doc_id long, text string").withColumns({"part": F.lit("x"), "number": F.lit("y"), "length": F.lit(-1)})
    rows = packing.pack(packing.cut_pieces(odd, tokenizer_path(), 1, 256), 256).collect()
    check_packing(rows, 256)
    assert sorted((str(r.doc_id), r.piece) for r in rows) == [("3", 0), ("3", 0), ("4", 0), ("4", 1), ("4", 2), ("None", 0), ("None", 0)]


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(2)
    payload = np.concatenate([rng.integers(0, 256, 48 * 60), np.repeat(rng.integers(0, 256, 40), 72), np.zeros(48 * 40)]).astype(np.uint8).tobytes()
    settings = tiff.TiffSettings(width=48, page_rows=50, strip_rows=7, compression=compression, predictor=predictor, tile=tile)
    media = tiff.encode(payload, settings)
    read = list(tiff.pages(media))
    assert b"".join(p.pixels.tobytes() for p in read) == payload
    assert [p.height for p in read] == [50, 50, 50, 10] and {p.compression for p in read} == {compression}


def test_tiff_big_endian_planar_and_broken_files():
    planes = [bytes(range(6)), bytes(range(10, 16))]
    entries = [(256, 4, 1, 3), (257, 4, 1, 2), (258, 3, 2, None), (259, 3, 1, 1), (273, 4, 2, None), (277, 3, 1, 2), (278, 4, 1, 2), (279, 4, 2, None), (284, 3, 1, 2)]
    base = 8 + 2 + 12 * len(entries) + 4
    extra = struct.pack(">II", base + 16, base + 22) + struct.pack(">II", 6, 6)
    out = struct.pack(">2sHIH", b"MM", 42, 8, len(entries))
    for tag, form, count, value in entries:
        if tag == 258:
            out += struct.pack(">HHIHH", tag, form, count, 8, 8)
        elif tag in (273, 279):
            out += struct.pack(">HHII", tag, form, count, base + 8 * (tag == 279))
        else:
            out += struct.pack(">HHI", tag, form, count) + (struct.pack(">HH", value, 0) if form == 3 else struct.pack(">I", value))
    media = out + struct.pack(">I", 0) + extra + b"".join(planes)
    (page,) = tiff.pages(media)
    assert page.pixels[:, :, 0].tobytes() == planes[0] and page.pixels[:, :, 1].tobytes() == planes[1]
    good = bytearray(tiff.encode(bytes(576)))
    good[4:8] = struct.pack("<I", len(good) + 99)
    for bad in (b"", b"II*\0", bytes(good), b"PNG" * 9):
        with pytest.raises(ValueError):
            list(tiff.pages(bad))
    with pytest.raises(ValueError):
        tiff.encode(b"")


def test_broken_directories_are_errors_and_nothing_else():
    rng = np.random.default_rng(3)
    payload = rng.integers(0, 256, 48 * 20).astype(np.uint8).tobytes()
    for kind in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        for tile in (None, 16):
            media = tiff.encode(payload, tiff.TiffSettings(width=48, page_rows=10, strip_rows=4, compression=kind, tile=tile))
            for _ in range(400):
                bad = bytearray(media)
                for at in rng.integers(0, len(bad), rng.integers(1, 6)):
                    bad[at] = rng.choice([0, 255, rng.integers(0, 256)])
                bad = bad[: rng.integers(1, len(bad) + 1)] if rng.random() < 0.2 else bad
                try:
                    assert sum(p.pixels.size for p in tiff.pages(bytes(bad))) < 4096 * len(bad) * 2
                except ValueError:
                    pass
    for tag, value in ((278, 0), (257, 2**31 - 1), (256, 0), (278, 2**32 - 1)):
        media = bytearray(tiff.encode(bytes(576)))
        at = struct.unpack_from("<I", media, 4)[0]
        for k in range(struct.unpack_from("<H", media, at)[0]):
            if struct.unpack_from("<H", media, at + 2 + 12 * k)[0] == tag:
                struct.pack_into("<I", media, at + 10 + 12 * k, value)
        if (tag, value) == (278, 2**32 - 1):
            assert [p.height for p in tiff.pages(bytes(media))] == [1]
        else:
            with pytest.raises(ValueError):
                list(tiff.pages(bytes(media)))
    bomb = tiff.inflate(zlib.compress(bytes(10**7)), 100)
    assert len(bomb) == 100


def test_digest_keeps_broken_files_and_reads_many_pages(spark):
    payload = bytes(range(256)) * 9 * 600
    good = tiff.encode(payload, tiff.TiffSettings(page_rows=100))
    bad = bytearray(good)
    struct.pack_into("<I", bad, 4, len(bad) + 5)
    rows = [(1, 5, bytearray(good)), (2, 5, bad), (None, 5, None), (1, 5, bytearray(good)), (4, 5, bytearray(b"junk"))]
    files = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").withColumns({"error": F.lit("x"), "page": F.lit(-1)})
    got = tiff.media_digest(files.coalesce(1)).collect()
    assert [(r.doc_id, r.error is None, r.payload_bytes) for r in got] == [(1, True, len(payload)), (2, False, None), (None, False, None), (1, True, len(payload)), (4, False, None)]
    assert got[0].payload_sha256 == got[3].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[0].tail_crc32 == zlib.crc32(payload[-32:])
    assert tiff.media_pages(files, batch_bytes=1).where("error is null").count() == 2 * 24


def test_media_of_documents(spark, docs, empty):
    media = tiff.text_to_media(docs).cache()
    got = {r.doc_id: r for r in tiff.media_digest(media).collect()}
    for i, t in enumerate(corpus()):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    pages = tiff.media_pages(media.select("doc_id", "media", F.lit(1).alias("page")))
    assert pages.where("error is null").select("doc_id").distinct().count() == docs.count()
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert tiff.media_pages(broken).where("error is not null and pixels is null").count() == 2
    assert tiff.media_digest(tiff.text_to_media(empty)).count() == 0 and tiff.media_pages(tiff.text_to_media(empty)).count() == 0


def test_license_scan_equals_brute_force(spark, empty):
    texts = [
        "Released under the MIT License.", "Apache License, Version 2.0 or CC BY-NC 4.0; cc by nc", None, "", "under the mit license under the MIT license",
        "This is licensed under the GNU General Public License version 3 or any later version", "SPDX-License-Identifier: BSD-3-Clause", "All rights reserved",
        "the BSD license and the Artistic License 2.0", "mit dem under the mitlicense", "Mozilla Public License v 2.0 " * 400, "cc0 1.0 universal public domain",
    ]
    rules = licenses.default_rules()
    assert len(rules) > 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    scanned = licenses.scan(df)
    for r in scanned.collect():
        w = words(texts[r.doc_id])
        places = [(k, l) for l, p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        body, reach, labels = f" {' '.join(w)} ", -1, {l for _, l in places}
        hits = sorted((m.start(), -m.end(), -x.priority, n, x.label) for n, x in enumerate(rules) if f" {x.keyword}" in body and x.also in body for m in re.finditer(rf"(?<= )(?:{x.pattern})(?= )", body))
        for h in hits:
            if -h[1] > reach:
                labels.add(h[4])
                reach = -h[1]
        starts = [k for k, _ in places] or [None]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts), max(starts))
        assert (r.base_labels, r.labels) == (",".join(sorted({l for _, l in places})), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1
    kept = licenses.detections(scanned).where("doc_id = 5").collect()
    assert [k.label for k in kept] == ["gpl-3-or-later"]
    assert licenses.scan(empty).count() == 0


def test_license_gates_hold_in_every_match(spark):
    rules = licenses.default_rules()
    texts = ["Released under the Expat license", "the X11 License", "FreeBSD license", "two clause license", "3-clause license", "GNU Library General Public License version 2", "PDDL license", "Do What The Fuck You Want To Public License", "SPDX-License-Identifier: GPL-2.0-or-later", "LGPL-2.1+ or later", "available under the ISC", "nothing here"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        body = f" {' '.join(words(t))} "
        free = sorted((m.start(), m.end(), x.label) for x in rules for m in re.finditer(rf"(?<= )(?:{x.pattern})(?= )", body))
        assert sorted((d["from"], d["to"], d["label"]) for d in got[i].detections) == free
    assert [got[i].labels for i in range(len(texts))] == ["mit", "mit", "bsd-2-clause", "bsd-2-clause", "bsd-3-clause", "lgpl-2", "pddl-1.0", "wtfpl", "gpl-2-or-later", "lgpl-2.1-or-later", "isc", ""]


@pytest.mark.parametrize("part", range(4))
def test_every_license_rule_is_reachable_through_its_gate(part):
    rules = licenses.default_rules()
    for x in rules[part::4]:

        @settings(max_examples=4, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
        @given(strategies.from_regex(re.compile(x.pattern, re.ASCII), fullmatch=True))
        def reachable(text):
            body = f" {text} "
            assert re.search(rf"(?<= )(?:{x.pattern})(?= )", body)  # noqa: B023
            assert f" {x.keyword}" in body and x.also in body, (x.label, x.keyword, text)  # noqa: B023

        reachable()


def test_license_texts_are_known(spark):
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "bsd-3-clause": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived",
        "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
        "gpl-2-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "apache-2": "you may not use this file except in compliance with the License.",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "cc-by-nc-sa-4.0": "https://creativecommons.org/licenses/by-nc-sa/4.0/",
        "": "granted permission, free software is used under conditions that are met in the public park",
    }
    rows = list(enumerate(texts.values()))
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(texts))


def test_url_rules_and_templates(spark):
    rows = [(1, "http://A.Example.COM/en/12?x"), (2, "https://example.com/en/77"), (3, None), (4, "no scheme"), (5, "x://h.net/de/8#t"), (6, "x://example.net/de/81"), (7, "x://com/en/"), (8, "x://xcom/en/"), (9, "a://b://c/d"), (9, "a://b://c/d"), (None, "x://q.org/es/1")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    seen = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert seen[1] == ("a.example.com", "/en/12", "com/en/", "block") and seen[2] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert seen[3] == seen[4] == ("", "", None, seen[3][3]) and seen[5][2:] == ("net/de/", "allow") and seen[6][2:] == ("example.net/de/8", "block")
    assert seen[7][2] == "com/en/" and seen[8][2] is None and seen[9][:2] == ("b:", "//c/d") and seen[None][3] == "block"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    bad = [(i, f"x://spam.org/es/{i}/item{i}") for i in range(60)] + [(100 + i, f"x://spam.org/{w}/{i}/item{i}") for i, w in enumerate(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))]
    by = urls.judge(spark.createDataFrame(bad, "page_id long, url string")).where("page_id >= 100").select("template").distinct().collect()
    assert len(by) == 1


def test_url_rules_are_those_of_the_contract(spark):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: kind for kind, h, p in urls.RULES} == contract
    rows = [(n, f"x://{'sub.' * sub}{rule}1") for n, rule in enumerate(contract) for sub in (0, 1)]
    assert {(r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()} == set(contract.items())


def judged(spark, rows, rules=urls.RULES, **kw):
    return urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, **kw).collect()


def test_url_verdicts_follow_labelled_evidence(spark):
    blocked = [(i, f"x://a.com/en/{i}") for i in range(40)]
    clean = [(200, "x://clean.info/about/us"), (201, "x://a.com/de/page"), (202, None)]
    beside = [(300 + i, f"x://a.com/fr/{i}") for i in range(9)]  # like the blocked branch in all that can be seen
    mostly_free = [(400 + i, f"x://b.com/{w}/{i}") for i, w in enumerate(["en"] * 5 + ["de"] * 30)]
    seen = {r.page_id: (r.rule, r.verdict, r.template) for r in judged(spark, blocked + clean + beside + mostly_free)}
    assert all(seen[i][1] == "block" for i, _ in blocked)
    assert seen[200][:2] == seen[201][:2] == seen[202][:2] == (None, "allow")
    assert all(seen[i] == (None, "block", "*/*") for i, _ in beside)
    assert {seen[i][:2] for i, u in mostly_free if "/de/" in u} == {(None, "allow")}


def test_one_label_rejects_nothing_and_ties_are_rejected(spark):
    rules = (("block", "bad.info", "/in/1"), ("block", "tie.info", "/in/1"))
    got = judged(spark, [(1, "x://bad.info/in/1"), (2, "x://bad.info/in/2")] + [(10 + i, "x://tie.info/in/1") for i in range(4)] + [(20, "x://tie.info/in/1")], rules)
    assert {r.page_id: r.verdict for r in got if r.page_id == 2} == {2: "allow"}
    tie = judged(spark, [(10 + i, "x://tie.info/in/1") for i in range(5)] + [(50 + i, "x://tie.info/in/2") for i in range(2)], rules, settings=urls.UrlSettings(strength=4.0, doubt=0.5))
    assert {r.purity for r in tie} == {0.5} and {r.verdict for r in tie} == {"block"}


def test_branches_merge_at_inner_levels_and_unlike_ones_stay_apart(spark):
    rules = (("block", "h.net", "/shop/a/"), ("allow", "h.net", "/shop/z/"))
    rows = [(i, f"x://h.net/shop/{w}/item/{i}") for i, w in enumerate(["a"] * 40 + ["b"] * 10 + ["z"] * 40)]
    rows += [(900 + i, f"x://h.net/shop/c/other/{i}/more") for i in range(10)]
    by = {r.path.split("/")[2]: (r.template, r.verdict) for r in judged(spark, rows, rules)}
    assert by["z"][1] == "allow" and by["c"] == ("shop/c/other/*/more", "allow")
    assert by["a"][0] == "shop/a/item/*" and by["z"][0] == "shop/z/item/*"  # their labels differ
    same = [(i, f"x://k.net/shop/{w}/item/{i}") for i, w in enumerate(["a"] * 30 + ["b"] * 10)]
    (template,) = {r.template for r in judged(spark, same, (("block", "k.net", "/shop/a/"),))}
    assert template == "shop/*/item/*"


def test_deep_paths_are_never_cut(spark):
    deep = "/".join(chr(97 + i) for i in range(14))
    got = judged(spark, [(1, f"x://d.net/{deep}/left"), (2, f"x://d.net/{deep}/right"), (3, f"x://d.net/{deep}/7/x"), (4, "x://d.net/" + "y" * 200_000)])
    assert {r.page_id: r.template for r in got if r.page_id < 4} == {1: f"{deep}/left", 2: f"{deep}/right", 3: f"{deep}/*/x"} and all(r.verdict == "allow" for r in got)


def test_both_verdicts_occur_among_urls_without_a_rule(spark):
    got = urls.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in got} == {"allow", "block"}


def test_perspectives(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 300, "bob", "late"), (2, 0, None, "x"), (3, 0, "system", "only"), (None, 1, "a", "b"), (1, 1, "ann", "hi")]
    got = chat.perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.participant, r.block): r for r in got}
    assert set(by) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (2, "unknown", 0)}
    ann = by[1, "ann", 0]
    spans = [tuple(map(int, s.split("-"))) for s in ann["mask"].split(",")]
    assert [ann.rendered[a:b] for a, b in spans] == ["hi<|im_end|>", "hi<|im_end|>", "bye<|im_end|>"]
    assert "<|im_start|>user name=bob\n<|im_end|>" in ann.rendered and ann.n_turns == 5 and by[1, "ann", 1]["mask"] == ""
    assert by[1, "ann", 0].start == 0 and by[1, "ann", 1].start == len(ann.rendered) and by[1, "bob", 1].start == len(by[1, "bob", 0].rendered)
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_blocks_of_a_long_dialogue_are_the_dialogue(spark):
    turns = [(1, t, "abc"[t % 3], "é" * (t % 5)) for t in range(700)] + [(1, 5, "a", "x" * 300_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"participant": F.lit("clash"), "block": F.lit(9)})
    parts = {}
    for r in chat.perspectives(df).collect():
        parts.setdefault(r.participant, []).append(r)
    (whole,) = [r for r in chat.perspectives(df, block=10**6).collect() if r.participant == "b"]
    rows = sorted(parts["b"], key=lambda r: r.block)
    assert "".join(r.rendered for r in rows) == whole.rendered and [r.start for r in rows] == [0, *itertools.accumulate(len(r.rendered) for r in rows[:-1])]
    spans = [tuple(r.start + int(x) for x in s.split("-")) for r in rows for s in r["mask"].split(",")]
    assert spans == [tuple(map(int, s.split("-"))) for s in whole["mask"].split(",")]


def test_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES if n != "pipeline"] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_runs_and_its_decisions_hold(spark):
    import corpus_pipeline

    sf, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns and docs.count() <= before.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    check_packing(rows, 4096)
    texts = [r.text for r in docs.collect()]
    assert not any(brute_links(texts)[0])
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, [r for r in packing.pack(packing.cut_pieces(docs, tokenizer_path(), 1, 4096), 4096).select("doc_id", "piece", "ids_crc32").collect()]))
