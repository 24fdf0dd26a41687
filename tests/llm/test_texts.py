"""Licences, language, quality, decontamination and tokens against brute force, with the odd cases."""

import hashlib
import re
import time
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language, lexicon, licenses, pieces, quality, tokenfile
from lodestone.llm.common import table
from lodestone.llm.queries import queries, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox " * 20_000


def documents(spark, *texts, langs=None):
    """Texts as documents, with a null id, repeated rows and columns that clash with the operators' own."""
    rows = [(k, t, (langs or ["en"] * len(texts))[k], "s", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "a null id", None, None, None)], SCHEMA)
    return docs.union(docs.limit(1)).withColumns({"score": F.lit(1), "low": F.lit("x"), "ids": F.lit(2), "lang_pred": F.lit("zz"), "leaks": F.lit(0)})


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licence_truth(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, k) for k, p in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in found}))


LICENCE_TEXTS = (
    None, "", "  \n ", "Released under the MIT License.", "UNDER_the--mit\nLICENSE under the mit license", "xunder the mit license, under the mit licenses", "CC BY-NC 4.0, cc by nc and cc-by-ncx",
    "Apache License, Version 2.0 éunder the mit license", "under the mİt license", LONG + "under the MIT license", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the Apache License, Version 2.0.", "cc\x00by\x7fnc", "under the mit license " * 300,
)


def test_license_scan(spark):
    rows = licenses.scan_licenses(documents(spark, *LICENCE_TEXTS)).collect()
    assert len(rows) == len(LICENCE_TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence_truth(LICENCE_TEXTS[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert by[10].labels == "gpl-3" and by[11].labels == "apache-2" and by[0].labels == ""
    assert licenses.scan_licenses(documents(spark, "x").limit(0)).count() == 0


def test_a_wider_detection_suppresses_what_it_contains(spark):
    text = "Licensed under the Creative Commons Attribution Non-Commercial license"
    assert licenses.scan_licenses(documents(spark, text)).where("doc_id = 0").first().labels == "cc-by-nc"


def test_there_are_hundreds_of_rules_and_all_compile(spark):
    rules = licenses.rules()
    assert len(rules) >= 200 and [r[0] for r in rules] == sorted(r[0] for r in rules)
    for _, _, _, rx in rules:
        re.compile(rx)


STATEMENTS = {
    "released under GPL v3": "gpl-3", "distributed under the terms of the GPL version 2": "gpl-2", "Available under CC BY-SA": "cc-by-sa", "provided under the MIT": "mit", "published under\nPSF": "python", "released under ODC-BY": "odc-by",
    "Proprietary and confidential": "proprietary", "for non-commercial use only": "non-commercial", "Permission to use, copy, modify, and distribute this software": "isc-text", "see wtfpl.net": "wtfpl", "https://mozilla.org/MPL/2.0/": "mpl-2", "eclipse.org/legal/epl-2.0": "epl-2", "eupl.eu": "eupl",
    "all rights\nreserved": "all-rights-reserved", "in the public\ndomain": "public-domain", "without warranty of any kind": "no-warranty", "permission is\nhereby granted, free of charge, to any person": "mit-text", "copyleft": "copyleft", "released under the SIL  Open\nFont License": "ofl",
    "understood; the domain is commercial, permission was reserved": "",
}


def test_every_rule_gets_past_the_gate(spark):
    docs = spark.createDataFrame(list(enumerate(STATEMENTS)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()} == dict(enumerate(STATEMENTS.values()))


SENTENCES = {
    "Creative Commons Attribution-ShareAlike": "cc-by-sa", "creative commons attribution sharealike 4.0": "cc-by-sa", "Attribution: creative commons attribution noncommercial": "cc-by-nc", "for noncommercial use only": "non-commercial", "Licensed under the Apache License v2": "apache-2", "apache-2.0": "apache-2",
    "mozilla public license v2": "mpl-2", "MPL-2.0": "mpl-2", "gnu general public license v3": "gpl-3", "GPLv3+": "gpl-3", "GPL 2.0 or later": "gpl-2", "LGPL-2.1": "lgpl-2.1", "bsd 3-clause license": "bsd-3", "the 2-clause BSD": "bsd-2", "example of simple replies, epl and mpl": "", "CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa", "cc0 1.0": "cc0", "EPL 2.0": "epl-2",
    "You may not use this file except in compliance with the License.": "apache-2", "modify it under the terms of the GNU Lesser General Public License": "lgpl", "account 4 by nc, success": "", "\u212aim, under the m\u0130t license": "",
}


def test_labels_of_usual_statements(spark):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()} == {k: v for k, v in enumerate(SENTENCES.values())}


def labels_truth(text):
    """Every match of every rule; one within another of the same or a better priority goes. No gate and no keywords."""
    low = text.translate(LOWER)
    found = sorted((m.start(), -m.end(), p, n) for p, _, n, rx in licenses.rules() for m in re.finditer(rx, low, re.ASCII))
    stays = [x for k, x in enumerate(found) if not any(y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] and (j < k or y[:2] != x[:2]) for j, y in enumerate(found) if j != k)]
    return ",".join(sorted({x[3] for x in stays} | set(filter(None, licence_truth(text)[4].split(",")))))


PARTS = ["licensed under ", "the ", "gnu ", "general public license ", "gpl", " v", "3", "2.1", ".0", "creative commons ", "attribution ", "share", "-alike ", "noncommercial ", "cc ", "by", "-", "nc ", "mit ", "license ", "license: ", "apache ", "version ", "bsd ", "3-clause ", "all rights reserved", ", ", "lesser ", "mpl ", "released under ", "terms of the ", "public domain ", "or later ", "x"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=20, max_size=60))
def test_labels_are_those_of_all_rules_by_brute_force(spark, texts):
    texts += [*STATEMENTS, *SENTENCES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        assert r.labels == labels_truth(texts[r.doc_id]), texts[r.doc_id]


def test_every_page_is_found(spark):
    pages = [(k, f"see {row[-2]}.") for k, row in enumerate(licenses.LICENSES)]
    for r in licenses.scan_licenses(spark.createDataFrame(pages, "doc_id long, text string")).collect():
        assert licenses.LICENSES[r.doc_id][0] in r.labels.split(",")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["under", " the ", "mit", "license", "cc", " by ", "nc", "-", "É", "\n", "apache ", "version ", "2"]), max_size=14).map("".join), min_size=1, max_size=20))
def test_license_places_are_those_of_the_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence_truth(texts[r.doc_id])


def test_language_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_texts(spark):
    texts = ["the cat and the dog " * 20, "le chat et le chien " * 20, None, "", "12 34 !?", LONG, "ß", "the cat and the dog " * 60 + "le chat et le chien " * 60]
    langs = ["en", "fr", "en", None, "en", "en", "fr", None]
    out = language.identify(documents(spark, *texts, langs=langs), language.learn(documents(spark, *texts, langs=langs)))
    assert out.columns[-3:] == ["lang_pred_", "lang_score", "lang_set"]
    got = {r.doc_id: (r["lang_pred_"], r.lang_set) for r in out.collect()}
    assert got[0] == ("en", ["en"]) and got[1] == ("fr", ["fr"]) and got[7][1] == ["en", "fr"]
    assert got[2][0] == got[3][0] == got[4][0] == "und"
    odd = spark.createDataFrame(list(enumerate(["² ½ ①", "٣٤", "_", "a²", "中", "ª"])), "doc_id long, text string")
    assert {r.doc_id for r in language.identify(odd, language.learn(documents(spark, *texts, langs=langs))).where("lang_pred = 'und'").collect()} == {0, 1, 2}
    empty = documents(spark, "x").limit(0)
    assert language.predict_languages(empty).count() == 0
    none = documents(spark, "abc", langs=[None]).where("doc_id = 0")
    assert {r.lang_pred for r in language.predict_languages(none).collect()} == {"und"}


def test_mixture_shares_against_brute_force():
    rng = np.random.default_rng(3)
    like = rng.random((50, 3))
    share = np.full(3, 1 / 3)
    for _ in range(language.EM_STEPS):
        post = like * share
        post /= post.sum(1, keepdims=True)
        share = post.mean(0)
    got, _ = language._mix(np.ones(50), like, np.zeros(50, int), np.zeros(1, int), np.ones((1, 3)))
    assert np.allclose(got[0], share, atol=1e-9)


SYLLABLES = "ba be bi bo bu ca ce ci co cu da de di do du fa fe fi fo fu".split()


def _languages(n):
    """Texts of n invented languages, each of its own words."""
    rng = np.random.default_rng(12)
    words = [["".join(rng.choice(SYLLABLES, 3)) + chr(97 + k) * 2 for _ in range(40)] for k in range(n)]
    return lambda k, size: " ".join(rng.choice(words[k], size))


def test_a_document_may_hold_any_number_of_languages(spark):
    text = _languages(7)
    rows = [(k, text(k % 7, 300), f"l{k % 7}") for k in range(70)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pred, score, sets = language.infer([" ".join(text(k, 400 + 40 * k) for k in range(7)), text(3, 50)], *learned)
    assert sets == [[f"l{k}" for k in range(7)], ["l3"]] and pred == ["l6", "l3"] and score[1] == 1.0 and abs(score[0] - 640 / 3640) < 0.02


def test_predictions_are_those_of_the_likeliest_set_by_brute_force(spark):
    """Every subset's maximum likelihood, by EM of its own from scratch, against the nested search; and the score is the share in the set."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    langs, table_, prior = language.learn(docs)
    rows = [r.text for r in docs.where("lang is not null").limit(60).collect() if language.has_letter(r.text)]
    rows += [a[:600] + " " + b[:600] for a, b in zip(rows[:12], rows[12:24], strict=True)]
    pred, score, sets = language.infer(rows, langs, table_, prior)
    agree = 0
    for text, p, s, chosen in zip(rows, pred, score, sets, strict=True):
        raw = b"  " + text.lower().encode().translate(language._TABLE) + b"   "
        codes = np.array([language._trigrams(np.frombuffer(raw[i : i + 3], np.uint8))[0] for i in range(len(raw) - 2)])
        log = np.array([table_[codes[a : a + language.WINDOW]].sum(0) for a in range(0, len(codes), language.WINDOW)], np.float64)
        weight = np.array([(codes[a : a + language.WINDOW] < language.FEATURES).sum() for a in range(0, len(codes), language.WINDOW)])
        like = np.exp(np.maximum(log - log.max(1, keepdims=True), -290))[weight > 0]
        weight = weight[weight > 0]
        best = None
        for m in range(1, len(langs) + 1):
            for some in combinations(range(len(langs)), m):
                own, share = like[:, some], np.full(m, 1 / m)
                for _ in range(60):
                    post = own * share
                    share = (post / post.sum(1, keepdims=True) * weight[:, None]).sum(0) / weight.sum()
                value = np.log((own * share).sum(1)).sum() - (m - 1) * (0.5 * np.log(max(2, -(-len(codes) // language.WINDOW))) + language.EXTRA_PENALTY)
                if best is None or value > best[0] + 1e-9:
                    best = value, some, share
        names = [langs[k] for k in best[1]]
        agree += names == chosen and names[int(best[2].argmax())] == p and abs(best[2].max() - s) < 0.02
    assert agree >= len(rows) - 1


def test_slices_of_a_long_text_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc de"), 5000)), "x", "".join(rng.choice(list("xyz "), 300))]
    learned = (["a", "b"], np.log(rng.random((language.FEATURES + 1, 2))).astype(np.float32), np.array([0.5, 0.5]))
    whole = language.infer(texts, *learned)
    monkeypatch.setattr(language, "_SLICE", 3)
    parts = language.infer(texts, *learned)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1]) and whole[2] == parts[2]


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    assert quality.score_quality(docs, labels).count() == docs.count()


def test_quality_odd_cases(spark):
    docs = documents(spark, None, "", "good text here. " * 9, "BAD!! TEXT!! " * 9, LONG)
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (3, 0, 1), (4, 1, 0), (None, 1, 0), (1, None, 0), (77, 5, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), labels)
    got = {r.doc_id: r.quality_score for r in quality.classify(docs, model).collect()}
    assert got[0] == got[1] == pytest.approx(model.prior) == pytest.approx(2 / 3) and got[2] > got[3] and all(0 <= s <= 1 for s in got.values())
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.quality_score for r in quality.classify(docs, nothing).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0


def test_the_sample_is_drawn_from_documents_that_are_there(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " * 5) for k in range(90, 100)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    assert len(quality.fit(docs, labels, sample=4).labels) == 8


def test_votes_are_those_of_the_nearest(spark):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abcDE!. |"), 80).tolist()) for _ in range(30)]
    v = rng.standard_normal((40, 5)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    model = quality.Model(np.ones(quality.FEATURES, np.float32), rng.standard_normal((quality.FEATURES, 5)).astype(np.float32), v, rng.integers(0, 2, 40).astype(np.float32))
    cos = model.project(quality.terms(texts)) @ v.T
    for row, got in zip(cos, model.score(texts), strict=True):
        near = np.argsort(-row)[: quality.NEIGHBOURS]
        w = np.maximum(row[near], 1e-3) ** quality.POWER
        assert got == pytest.approx((w * model.labels[near]).sum() / w.sum(), rel=1e-4)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def leaks_of(text, *items):
    return decontaminate.Index(list(enumerate(items))).find(text)


def test_substitutions_are_tolerated():
    words = ITEM.split()
    assert leaks_of(f"start {ITEM.upper()}. end", ITEM)[0] == (1, 20, 20)
    for k in range(20):
        assert 0 in leaks_of("x " + " ".join(words[:k] + ["other"] + words[k + 1 :]) + " y", ITEM)
    two = [w if k not in (5, 12) else "zz" for k, w in enumerate(words)]
    assert leaks_of(" ".join(two), ITEM)[0] == (0, 20, 18)
    assert leaks_of(" ".join(words[:12]), ITEM) == {} and leaks_of(" ".join(reversed(words)), ITEM) == {}


@pytest.mark.parametrize("size", range(14, 21))
def test_every_replacement_pattern_that_the_rule_admits_is_found(size, monkeypatch):
    item = [f"w{k}" for k in range(size)]
    index = decontaminate.Index([(0, " ".join(item))])
    monkeypatch.setattr(decontaminate, "HELD", 32, raising=False)  # several parts
    for n in range(1, size // 5 + 1):
        if size - n >= decontaminate.MATCHED:
            for places in combinations(range(1, size - 1), n):
                if "xxxx" not in (shown := "".join("x" if k in places else "." for k in range(size))):
                    text = " ".join("zz" if k in places else w for k, w in enumerate(item))
                    assert index.find(f"a b {text} c d") == {0: (2, size, size - n)}, shown


def test_chance_equal_words_beside_a_passage_hide_nothing():
    item = [f"w{k}" for k in range(40)]
    text = [f"n{k}" for k in range(40)]
    text[14:27] = item[14:27]
    for k in (10, 30):
        item[k] = text[k] = "the"
    assert leaks_of(" ".join(text), " ".join(item)) == {0: (10, 17, 14)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([True, True, True, False]), max_size=60))
def test_the_best_stretch_of_a_diagonal_is_that_of_brute_force(same):
    best = 0
    for a in range(len(same)):
        for b in range(a, len(same)):
            part = same[a : b + 1]
            if sum(part) >= decontaminate.MATCHED and 5 * sum(part) >= 4 * len(part) and "0" * decontaminate.GIVE_UP not in "".join("01"[x] for x in part):
                best = max(best, sum(part))
    got = decontaminate.Index._overlap(np.array(same, bool))
    assert (got[2] if got else 0) == best and (got is None or sum(same[got[0] : got[0] + got[1]]) == got[2] >= 0.8 * got[1])


def test_case_is_ignored_in_any_alphabet():
    item = " ".join(f"été{k} ñu{k}" for k in range(10))
    assert leaks_of(item.upper(), item)[0] == (0, 20, 20)


def test_short_items_match_whole_or_not_at_all():
    assert leaks_of("a one two three four five six b", "one two three four five six")[0] == (1, 6, 6)
    assert leaks_of("one two three four five sex", "one two three four five six") == {}
    assert leaks_of("one two three", "one two three") == {}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_every_overlap_of_the_tolerated_kind_is_found(seed):
    rng = np.random.default_rng(seed)
    item = [f"w{k}" for k in rng.integers(0, 500, 30)]
    part = list(item[int(rng.integers(0, 10)) :][:20])
    part[int(rng.integers(6, 14))] = "changed"
    noise = [f"n{k}" for k in rng.integers(0, 500, 50)]
    assert 0 in leaks_of(" ".join(noise[:25] + part + noise[25:]), " ".join(item))
    assert leaks_of(" ".join(noise), " ".join(item)) == {}


def leak_truth(text, item):
    """The most equal tokens of any stretch of any diagonal that the rule calls a leak, by brute force."""
    own, other = decontaminate.tokens_of(text), decontaminate.tokens_of(item)
    best = 0
    for shift in range(-len(other) + 1, len(own)):
        same = [own[k] == other[k - shift] for k in range(max(0, shift), min(len(own), shift + len(other)))]
        for a in range(len(same)):
            equal = miss = 0
            for b in range(a, len(same)):
                equal, miss = equal + same[b], 0 if same[b] else miss + 1
                if miss >= decontaminate.GIVE_UP or not same[a]:
                    break
                if same[b] and equal >= decontaminate.MATCHED and 5 * equal >= 4 * (b - a + 1):
                    best = max(best, equal)
    return best


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_leaks_are_those_of_brute_force_under_random_substitutions(seed):
    rng = np.random.default_rng(seed)
    words = int(rng.choice([6, 40, 400]))  # few words: much is equal by chance
    item = [f"w{k}" for k in rng.integers(0, words, int(rng.integers(13, 40)))]
    a = int(rng.integers(0, len(item) - 12))
    part = [w if rng.random() > rng.choice([0.0, 0.1, 0.2, 0.3]) else f"w{rng.integers(0, words)}" for w in item[a : a + int(rng.integers(12, 30))]]
    noise = [f"w{k}" for k in rng.integers(0, words, 20)]
    text = " ".join([*noise[:9], *part, *noise[9:]])
    got = leaks_of(text, " ".join(item))
    assert (got[0][2] if got else 0) == leak_truth(text, " ".join(item))


def test_find_and_drop_leaks(spark, monkeypatch):
    docs = documents(spark, None, "", f"x {ITEM} y", LONG, "clean words only here")
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, ""), (None, ITEM), (10, "a b")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, r["items"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got[2] == (True, 1, [7]) and all(not v[0] for k, v in got.items() if k != 2)
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontaminate.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 10)  # several passes give the same
    assert {r.doc_id: r["items"] for r in decontaminate.find_leaks(docs, bench).collect()} == {k: v[2] for k, v in got.items()}


ODD_TEXTS = (
    None, "", " ", "Hello World don't I'LL 's", "a<|endoftext|>b <|startoftext|>", "İstanbul Σίσυφος straße ÀÉ×÷", "é ́x a b\tc\x0bd\r\ne", "12345 x²½ ٣", "日本語 🙂👍🏽", "th" * 3000, "\x00\x01", "ﬁ K Å", LONG[:50_000],
)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe_is_the_librarys(spark, library):
    docs = documents(spark, *ODD_TEXTS)
    rows = lexicon.encode_documents(docs, vocabulary_path()).where("doc_id is not null").collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    digests = {r.doc_id: r for r in lexicon.digest_documents(docs, vocabulary_path()).collect()}
    for r in rows:
        want = library.encode(ODD_TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
        d = digests[r.doc_id]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest())
    assert lexicon.encode_documents(docs.limit(0), vocabulary_path()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text_is_encoded_as_the_library_does(library, text):
    global _codec
    if "_codec" not in globals():
        _codec = lexicon.Codec(lexicon.Vocabulary.load(vocabulary_path()), lexicon.Transducer(lexicon.compile_transducer({})))
    want = library.encode(text, add_special_tokens=False).ids
    assert _codec.encode([text])[0] == want
    assert np.frombuffer(tokenfile.encoder(_codec.vocabulary.text)([text])[0], "<u2").tolist() == [*want, tokenfile.END]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("'srtvemld aZ9!~ÀÞßéÿ\n", max_size=20), max_size=6))
def test_spans_are_the_words_of_each_text(texts):
    bounds, short = pieces.spans(b"".join(t.encode() + pieces.STOP for t in texts))
    got = [short[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == [w for t in texts for w in (*pieces.units(t, []), pieces.STOP.decode())]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text("'sTll é×\t\0\1ab—<|endoftext|>", max_size=20) | st.sampled_from(["", "it's <|endoftext|> x", "plain words"]), min_size=1, max_size=5), min_size=1, max_size=4))
def test_groups_of_plain_and_other_texts_are_encoded_as_the_library_does(library, groups):
    global _flat
    if "_flat" not in globals():
        _flat = tokenfile.flat_encoder(Path(vocabulary_path()).read_text(encoding="utf-8"))
    for texts, (ids, sizes) in zip(groups, _flat([[t.encode() for t in texts] for texts in groups]), strict=True):
        want = [[*library.encode(t, add_special_tokens=False).ids, tokenfile.END] for t in texts]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [k for one in want for k in one]


def test_known_words_cost_less_than_a_pattern_that_finds_them():
    """no step of the encoder is made once a word of the text, as the pattern's matches are."""
    texts = [" ".join(f"w{chr(97 + k * j % 23)}{chr(97 + k % 26)}" for k in range(2000)) for j in range(1, 257)]
    encode = tokenfile.encoder(Path(vocabulary_path()).read_text(encoding="utf-8"))

    def least(work):
        took = []
        for _ in range(5):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: encode(texts)) < least(lambda: [pieces.units(t, []) for t in texts])


def test_texts_longer_than_a_group_are_whole(spark, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "GROUP_BYTES", 20)
    monkeypatch.setattr(tokenfile, "HELD_BYTES", 50)
    texts = ["", "a b", "it's " * 30, None, "tab\tbed", "c", "ÉTÉ " * 9, "d", ""]
    docs = documents(spark, *texts).where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)
    vocabulary = lexicon.Vocabulary.load(vocabulary_path())
    rows = tokenfile.ids_table(docs, vocabulary.text, len(vocabulary.tokens), 2).collect()
    want = {k: [*library.encode(t or "", add_special_tokens=False).ids, tokenfile.END] for k, t in enumerate(texts)}
    assert {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in rows} == want and len(rows) == len(texts)
    (counts,) = [r.counts for r in rows if r.counts is not None]
    assert np.frombuffer(counts, "<i8").tolist() == np.bincount([k for ids in want.values() for k in ids], minlength=len(vocabulary.tokens)).tolist()


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 60_000), max_size=4), max_size=40), st.lists(st.binary(max_size=6), max_size=10))
def test_transducer_accepts_its_words_alone(entries, others):
    t = lexicon.Transducer(lexicon.compile_transducer(entries))
    words = [*entries, *others]
    assert t.lookup(words) == [entries.get(w) for w in words]


def test_transducer_shares_suffixes():
    t = lexicon.Transducer(lexicon.compile_transducer({w: [1] for w in (b"walking", b"talking", b"stalking")}))
    assert len(t.final) < 3 * 7


def test_merging_many_words_is_merging_each():
    v = lexicon.Vocabulary.load(vocabulary_path())
    words = ["the", "thing", "a", "zzzz", "x" * 40, "anan" * 5, "qq"]
    assert v.merge_all(words) == [v.merge(w) for w in words] and v.merge("ab" * 60) == v._merge_long([*("ab" * 60)[:-1], "b</w>"])


def test_a_folder_holds_all_that_its_reader_needs(spark, library):
    """Files written by one process are decoded by another that has only their path."""
    import subprocess
    import sys

    docs = documents(spark, *ODD_TEXTS).where("doc_id is not null").dropDuplicates(["doc_id"])
    path = tokenfile.shared_path(spark, "tokens")
    vocabulary = lexicon.Vocabulary.load(vocabulary_path())
    ids = tokenfile.cut(tokenfile.ids_table(docs, vocabulary.text, len(vocabulary.tokens), 2), "ids")
    order, total = tokenfile.rank_table(ids, len(vocabulary.tokens))
    tokenfile.write(ids, path, order, 2, total)
    code = f"""
import sys, pathlib
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from lodestone.llm import tokenfile
(ranks,) = pathlib.Path({path.removeprefix('file://')!r}, "ranks").glob("*.txt")
order = tokenfile.parse_ranks(ranks.read_bytes())
for f in sorted(pathlib.Path({path.removeprefix('file://')!r}, "files").glob("*.txt")):
    _, _, docs, sizes, ids = tokenfile.parse(f.read_bytes(), order)
    at = 0
    for d, n in zip(docs, sizes.tolist()):
        print(d, *ids[at : at + n].tolist())
        at += n
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    got = {int(x.split()[0]): list(map(int, x.split()[1:])) for x in out.splitlines()}
    assert got == {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(ODD_TEXTS)}
    rows = tokenfile.read(spark, path, "n long", lambda x: (len(x),), [tokenfile.pa.int64()]).collect()
    assert {r.doc_id: r.n for r in rows} == {k: len(v) for k, v in got.items()}


def test_token_files_round_trip(spark, library):
    docs = documents(spark, *ODD_TEXTS).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = tokenfile.round_trip(docs, vocabulary_path()).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(rows, ODD_TEXTS, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.round_trip(docs.limit(0), vocabulary_path()).count() == 0
    again = tokenfile.round_trip(documents(spark, *ODD_TEXTS), vocabulary_path())
    assert again.count() == len(ODD_TEXTS) + 2 and again.where("doc_id is null").first().start == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), min_size=1, max_size=8))
def test_packed_ranks_come_back(lists):
    sizes = np.array([len(x) for x in lists])
    control, data = tokenfile.pack(np.array([k for x in lists for k in x], np.uint32), sizes)
    assert len(control) == sum(-(-n // 4) for n in sizes)
    assert tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), sizes).tolist() == [k for x in lists for k in x]


def test_files_are_in_order_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 400)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = tokenfile.round_trip(docs, vocabulary_path()).orderBy("doc_id").collect()
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()


def test_registered_queries_give_a_row_a_document(spark):
    n = table(spark, "/root/testdata/sf0.001", "documents").count()
    for name in ("op3_simhash", "op4_license_scan", "op5_hmm", "op6_quality", "op7_token_file", "op8_decontaminate", "op9_language", "op10_bpe"):
        assert queries()[name](spark, "/root/testdata/sf0.001").count() == n
