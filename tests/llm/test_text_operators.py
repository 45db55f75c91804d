"""Licences, language, tokens, packing: each against a plain rendering of its definition."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from swarmframe.llm import language_id as LI
from swarmframe.llm import license_scan as LS
from swarmframe.llm import packing as PK
from swarmframe.llm import token_counts as TC
from swarmframe.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, extra string"
ODD = [
    (1, None, None, None, "x"), (2, "", "en", "a", None), (3, " \n\t ", "en", "a", "y"), (4, "Hello wörld, it's 42!", "en", None, "y"),
    (4, "Hello wörld, it's 42!", "en", None, "y"), (5, "x " * 30_000, "de", "b", "y"), (6, "\x1c\x85   　a\x00b", "en", "b", "y"), (None, "no id", "en", "b", "z"),
]
ALPHABET = [*"aAbZ éÉßİıΣσς0½²٣ \t\n\r\x0b\x0c\x1c\x1f\x85   　'’.,!?-_<|>#\x00\x02\x7f👍日本語́̈ﬁȺ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "  ", " \n", "\n \n"]


def noise(n, most=40, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


# ---- licences ---------------------------------------------------------------------


def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    found = [(i, i + phrase.count(" "), label) for phrase, label in LS.BASE for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    return len(words), found


def check_base(row, text):
    n, found = plain_base(text)
    assert (row.n_words, row.n_base) == (n, len(found))
    assert row.first_word == min((a for a, _, _ in found), default=None)
    assert row.base_labels == ",".join(sorted({x for _, _, x in found}))
    assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(","))
    assert 0 <= row.score <= 1


def test_base_places_on_all_documents(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    rows = LS.op1_license_scan(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check_base(r, texts[r.doc_id])


@pytest.mark.parametrize("text, labels", [
    ("Under the MIT-License under the mit license", "mit"), ("CC BY-NC cc by nc/CC-BY_NC", "cc-by-nc"), ("Apache License, Version 2.0", "apache-2"),
    ("apache license version 1", ""), ("Released undr the MIT Licence.", "mit"), ("under the bsd license", ""), ("CC BY-ND", ""), ("CC-BY-SA 4.0", "cc-by-sa"),
    ("GNU Genral Public Licence, version 3", "gpl-3"), ("ünder the mit license", "mit"), ("the mit licenses", ""), ("Thunder the mit license", "mit"),
])
def test_fuzzy_notices(text, labels):
    n, matches, exact = LS.Scanner().scan(text)
    found = ",".join(sorted({m[0] for m in matches} | {e[0] for e in exact}))
    if labels or not found:
        assert found == labels
    base = plain_base(text)
    assert (n, sorted((a, b, x) for x, a, b in exact)) == (base[0], sorted(base[1]))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_seeds_lose_no_occurrence_within_the_bound():
    """Random edits of each notice within its bound are found, and every span reported keeps to it."""
    draw, scanner = random.Random(5), LS.Scanner()
    for notice in LS.NOTICES:
        for _ in range(40):
            chars = list(notice.phrase)
            for _ in range(draw.randint(0, notice.errors)):
                at = draw.randrange(1, len(chars) - 1)
                draw.choice([lambda: chars.__setitem__(at, draw.choice("xyz")), lambda: chars.insert(at, draw.choice("xyz")), lambda: chars.pop(at)])()
            text = "some words " + "".join(chars) + " " + notice.exact + " and more"
            words = " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text))
            if edits("".join(chars).strip(), notice.phrase) > notice.errors:
                continue
            _, matches, _ = scanner.scan(text)
            assert any(m[0] == notice.label for m in matches), (notice, text)
            for label, start, end, e in matches:
                whole = [f"{x.phrase} {x.exact}".strip() for x in LS.NOTICES if x.label == label]
                assert any(edits(words[start:end], w) <= e for w in whole)


def test_license_edges(odd):
    rows = LS.scan_licenses(odd).collect()
    assert len(rows) == len(ODD)
    for r, (doc, text, *_) in zip(rows, ODD, strict=True):
        assert r.doc_id == doc
        check_base(r, text)
    assert LS.scan_licenses(odd.limit(0)).count() == 0
    long = "word " * 200_000 + "under the mit license"
    assert LS.Scanner().scan(long)[2] == [("mit", 200_000, 200_003)]
    import time

    began = time.perf_counter()
    places = LS.Scanner().scan("under the mit license " * 60_000)[2]
    assert len(places) == 60_000 and places[-1] == ("mit", 239_996, 239_999) and time.perf_counter() - began < 30  # linear in the text


# ---- language ---------------------------------------------------------------------


def test_held_out_accuracy(spark, data):
    found = LI.op2_language_id(spark, data).join(table(spark, data, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    assert len(held) > 10 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.98


def test_folded_model_is_the_kernel_machine():
    """The one-matrix scorer against kernels of plain n-gram sets, landmarks and ridge written out."""
    texts = ["the cat sat on the mat", "a dog and the cat", "der hund und die katze", "die maus im haus", "le chat et le chien", "la souris est la"]
    langs = ["en", "en", "de", "de", "fr", "fr"]
    model = LI.fit_language_model(texts, langs, landmarks=2)
    grams = LI.Grams()

    def presence(t):
        row = np.zeros(1 << LI.GRAM_BITS, np.uint8)
        grams.mark(t, row)
        return set(np.flatnonzero(row))

    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    sets = [presence(t) for t in texts]
    order = [i for lang in model.languages for i in range(6) if langs[i] == lang]
    square = np.array([[kernel(sets[i], sets[j]) for j in order] for i in order])
    values, vectors = np.linalg.eigh(square)
    root = vectors / np.sqrt(values)
    features = np.array([[kernel(s, sets[j]) for j in order] for s in sets]) @ root
    new = presence("the dog is in the house")
    for k, lang in enumerate(model.languages):
        y = np.array([1.0 if x == lang else -1.0 for x in langs])
        w = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        beta = np.linalg.solve(features.T @ (features * w[:, None]) + LI.RIDGE * np.eye(len(order)), features.T @ (w * y))
        want = np.array([kernel(new, sets[j]) for j in order]) @ root @ beta
        got = sum(model.weights[g, k] for g in new) / np.sqrt(len(new))
        assert abs(want - got) < 1e-3
    assert model.scorer()(texts)[0] == langs


def test_every_language_is_learned(spark):
    """More languages than there are landmarks to share out."""
    draw = random.Random(2)
    letters = [chr(0x4E00 + 40 * k) for k in range(400)]
    rows = [(n, "".join(draw.choice([a, chr(ord(a) + 1), " "]) for _ in range(30)), f"l{k:03}") for n, (k, a) in enumerate((k, a) for k, a in enumerate(letters) for _ in range(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = LI.learn_languages(docs)
    assert len(model.languages) == 400
    found = LI.identify_languages(docs, model).collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.95


def test_scores_decide_in_the_pipeline(spark, data):
    """Texts in a language that was not learned, in two, or in none go; nearly all of one language stay."""
    docs = table(spark, data, "documents")
    of = {lang: max((r.text for r in docs.where(F.col("lang") == lang).collect() if r.text), key=len).split()[:150] for lang in ("en", "de", "fr")}
    draw = random.Random(3)
    salad = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(150))
    odd_ones = [salad("αβγδεζηθικλμνξοπρστυφχψω"), salad("abcdefghijklmnopqrstuvwxyz"), " ".join(of["en"] + of["de"]), " ".join(of["fr"] + of["en"]), "7 7 a 7"]
    more = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(odd_ones)], "doc_id long, text string")
    both = docs.unionByName(more.select(*[F.col(c) if c in more.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))
    kept = corpus_pipeline.language(spark, both, data)
    assert kept.columns == docs.columns
    found = [r.doc_id for r in kept.collect()]
    assert min(found) >= 0 and len(found) >= 0.9 * docs.count()


def test_language_edges(spark, odd):
    none = LI.learn_languages(odd.limit(0))
    assert [r.lang_pred for r in LI.identify_languages(odd, none).collect()] == ["und"] * len(ODD)
    clash = odd.withColumn("lang_pred", F.lit("q")).withColumn("lang_score", F.lit(1))
    kept = LI.keep_identified(clash, LI.fit_language_model(["hello there", "guten tag"], ["en", "de"]))
    assert kept.columns == clash.columns and LI.identify_languages(clash, none).columns.count("lang_pred") == 1
    assert Counter(r.doc_id for r in kept.collect()) == Counter({4: 2, 5: 1, 6: 1, None: 1})
    assert LI.keep_identified(clash.limit(0), none).count() == 0
    one = LI.fit_language_model(["only one"], ["en"])
    assert one.scorer()(["text", None, "123", "𝔞𝔟"])[0] == ["en", "und", "und", "en"]


# ---- tokens -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def byte_library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(TC.default_vocabulary())


def test_counts_equal_the_library(spark, data, byte_library):
    counter = TC.PairCounter(TC.default_vocabulary())
    texts = [r.text for r in table(spark, data, "documents").collect()] + noise(6000) + ["", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", " " * 50, "a   b", "x\n \n y"]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in byte_library.encode_batch(texts, add_special_tokens=False)]


def test_classes_of_characters_agree(byte_library):
    counter = TC.PairCounter(TC.default_vocabulary())
    texts = [f"a{chr(c)} {chr(c)}b" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in byte_library.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_are_refused(tmp_path):
    import json

    with open(TC.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    with pytest.raises(ValueError):
        TC.PairCounter(PK.default_vocabulary())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        (tmp_path / "x.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            TC.PairCounter(str(tmp_path / "x.json"))


def test_a_full_table_changes_nothing():
    small, large = (TC.PairCounter(TC.default_vocabulary(), n) for n in (3, 100_000))
    texts = noise(500, seed=3)
    assert [small.count(t) for t in texts] == [large.count(t) for t in texts]


def test_token_edges(odd):
    rows = TC.count_tokens(odd).collect()
    assert [(r.doc_id, r.n_bytes) for r in rows] == [(d, len((t or "").encode())) for d, t, *_ in ODD]
    assert rows[0].n_tokens == rows[1].n_tokens == 0 and rows[5].over_limit and not rows[3].over_limit
    assert TC.count_tokens(odd.limit(0)).count() == 0


# ---- packing ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(PK.default_vocabulary())


def test_ids_equal_the_library(spark, data, word_library):
    texts = [r.text for r in table(spark, data, "documents").collect()] + noise(6000, seed=2) + ["", None, "\x02", "a\x02b <|endoftext|>x"]
    tokens = PK.Tokens(PK.default_vocabulary(), 500)
    got = [tokens.encode(t) for t in texts]
    for g, e in zip(got, word_library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == e.ids


def check_packing(rows, texts, library):
    whole = {k: [*e.ids, 1] for k, e in zip(texts, library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(whole[r.doc_id])
    assert by_doc.keys() == whole.keys()
    for doc, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(whole[doc])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= PK.LENGTH
        padding += PK.LENGTH - at
    return padding / (PK.LENGTH * len(by_sequence))


def test_packing_whole_table(spark, data, word_library):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    assert check_packing(PK.op6_packing(spark, data).collect(), texts, word_library) < 0.05


def test_short_texts_leave_little_padding(spark, word_library):
    draw = random.Random(8)
    texts = {k: " ".join(draw.choice(["some", "words", "of", "text"]) for _ in range(draw.randint(0, 30))) for k in range(4000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert check_packing(PK.pack_sequences(docs).collect(), texts, word_library) < 0.04


def test_lengths_are_rounded_alike(spark):
    for unit in (1, 2, 4, 8):
        got = spark.range(1, 2049).select(PK.units_of(F.col("id"), unit, 2048).alias("u")).collect()
        want = [-(-n // PK.step_for(n, unit)) * PK.step_for(n, unit) // unit for n in range(1, 2049)]
        assert [r.u for r in got] == want and max(want) * unit == 2048


def test_packing_edges(spark, odd, word_library):
    rows = PK.pack_sequences(odd).collect()
    assert Counter((r.doc_id, r.start) for r in rows)[(4, 0)] == 2 and sum(r.doc_id is None for r in rows) == 1
    unique = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(PK.pack_sequences(unique).collect(), {d: t for d, t, *_ in ODD if d is not None}, word_library)
    assert PK.pack_sequences(odd.limit(0)).count() == 0


def test_patterns_against_exhaustive_packing():
    """Small histograms: the plan is within one sequence of the best there is, and uses every item once."""
    draw = random.Random(4)

    def best(items, room):
        least = [len(items)]

        def go(rest, open_):
            if len(open_) >= least[0]:
                return
            if not rest:
                least[0] = len(open_)
                return
            tried = set()
            for k, left in enumerate(open_):
                if left >= rest[0] and left not in tried:
                    tried.add(left)
                    go(rest[1:], [*open_[:k], left - rest[0], *open_[k + 1 :]])
            go(rest[1:], [*open_, room - rest[0]])

        go(sorted(items, reverse=True), [])
        return least[0]

    for _ in range(25):
        items = [draw.randint(1, 12) for _ in range(draw.randint(1, 10))]
        plan = PK.draw_plan(dict(Counter(items)), 12)
        fill = Counter()
        for size, first, n, times, sequence, _ in plan:
            assert n % times == 0
            for k in range(n):
                fill[sequence + k % times] += size
        assert max(fill.values()) <= 12 and sum(fill.values()) == sum(items) and len(fill) <= best(items, 12) + 1
        for size in set(items):
            spans = sorted((f, f + n) for s, f, n, *_ in plan if s == size)
            assert spans[0][0] == 0 and spans[-1][1] == items.count(size) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert PK.draw_plan({}, 12) == []
