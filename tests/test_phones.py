"""Phones, the measures on them, syllables, the extended Sift4 and n-grams of several lengths."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.functions import alignments, edits, phones, tokenizers
from textloom.operators import corpus

# Bundles of IPA strings.
BUNDLES = {
    "mut": [2709662981243185770, 1825831513894594986, 2783230754502126250], "telz": [2783230754502126250, 1826957430176000426, 2693158761954453926, 2783230754501863834],
    "iç": [1826957412996131242, 2783233463150094762], "kvatʃ": [2783233462881659562, 2781702983095069098, 1826957425952336298, 2783230754502126250, 2783231556184615322], "klø": [2783233462881659562, 2693158761954453926, 1825831530269157802],
    "t͡s": [2783230754502126489], "ʔ?": [2783233503281179306, -1], "tʰ": [2783230754502126250, 65536],
}


@pytest.mark.parametrize("ipa", BUNDLES)
def test_bundles(ipa):
    assert phones.ipa_to_features(ipa) == BUNDLES[ipa]


def test_features(spark):
    rows = spark.createDataFrame([("telz",), ("?",), ("",), (None,)], "w string").select(phones.features(F.col("w")).alias("p"))
    got = rows.select(phones.feature(F.col("p"), "consonantal").alias("c"), phones.feature(F.col("p"), "sonorant").alias("s"), phones.feature_maps(F.col("p")).alias("m"), phones.likeness(F.get(F.col("p"), 2), F.get(F.col("p"), 3)).alias("l")).collect()
    assert got[0].c == [1, -1, 1, 1] and got[0].s == [-1, 1, 1, -1] and got[0].m[0]["round"] == "0" and got[0].m[1]["labial"] == "+" and got[0].l == pytest.approx(0.8709677419354839)
    assert math.isnan(got[1].c[0]) and got[1].m == [{}] and got[2].c == [] and got[3].c is None
    with pytest.raises(AttributeError):
        phones.feature(F.col("p"), "no such")


def test_likeness():
    def one(x):
        return phones.ipa_to_features(x)[0]

    assert phones.cmp_features(one("l"), one("i")) == pytest.approx(0.564516129032258) and phones.cmp_features(-1, -1) == 0 and phones.cmp_features(one("l"), one("l")) == 1
    with pytest.raises(TypeError):
        phones.cmp_features(one("l"), one("i"), 3)


# Phonetic edit distances.
EDITS = [("cat", "hat", {}, 0.17741935483870974), ("Niall", "Neil", {}, 1.161290322580645), ("aluminum", "Catalan", {}, 2.467741935483871), ("ATCG", "TAGC", {}, 1.193548387096774), ("ATCG", "TAGC", {"swap": True}, 0.46236225806451603), ("ACTG", "TAGC", {"swap": True}, 1.2580645161290323), ("Nigel", "Niall", {"weights": {"syllabic": 1.0}}, 0), ("Nigel", "Niall", {"weights": (1, 1, 1)}, 0.33333333333333326), ("a", "", {}, 1), ("", "abc", {}, 3)]


@pytest.mark.parametrize("a,b,how,distance", EDITS)
def test_phonetic_edit(a, b, how, distance):
    assert phones.phonetic_edit_distance(a, b, **how) == pytest.approx(distance)


# ALINE's alignments and scores.
ALIGNED = [
    ("driy", "tres", [(75.0, "‖ d r iy ‖", "‖ t r e  ‖ s")]), ("blow", "flare", [(53.0, "‖ b l o ‖ w", "‖ f l a ‖ re")]), ("ful", "plenus", [(48.0, "‖ f u l ‖", "‖ p - l ‖ enus")]), ("tuwz", "dentis", [(75.0, "‖ t uw z ‖", "den ‖ t i  s ‖")]),
    ("jo", "zPe", [(29.0, "‖ j  o ‖", "‖ zP e ‖")]), ("ombre", "om", [(50.0, "‖ o m ‖ bre", "‖ o m ‖"), (50.0, "‖ o mb ‖ re", "‖ o m  ‖")]), ("detSir", "dir", [(65.0, "de ‖ tS i r ‖", "‖ d  i r ‖"), (65.0, "‖ d e tS i r ‖", "‖ d - -  i r ‖")]),
    ("atcg", "tagc", [(65.0, "‖ a t c ‖ g", "t ‖ a g c ‖"), (65.0, "a ‖ tc - g ‖", "‖ t  a g ‖ c")]), ("fedSeCr", "feHdeCr", [(124.0, "‖ f e  dS eC r ‖", "‖ f eH d  eC r ‖")]),
]


@pytest.mark.parametrize("a,b,found", ALIGNED)
def test_aline(a, b, found):
    assert phones.Aline().alignments(a, b) == found and phones.Aline().score(a, b) == found[0][0]


def test_aline_modes():
    assert phones.aline("Cat", "hat") == pytest.approx(1 - 0.4117647058823529) and phones.aline("", "") == 1 and phones.aline("a", "") == 0 and phones.aline("??", "a") == 0
    for mode in ("local", "global", "half-local", "semi-global"):
        cmp = phones.Aline(mode=mode, phones="ipa")
        assert cmp.similarity("niːl", "niːl") == 1 and all(score == pytest.approx(cmp.score("kat", "katʰa")) for score, _, _ in cmp.alignments("kat", "katʰa"))
    assert len(phones.Aline().alignments("nat", "nixt", epsilon=0.3)) > len(phones.Aline().alignments("nat", "nixt")) == 2


@pytest.mark.parametrize("mode", ["local", "global", "half-local", "semi-global"])
def test_aline_tables_follow_the_moves(mode):
    cmp = phones.Aline(mode=mode)
    for a, b in (("driy", "tresH"), ("fedSeCr", "feHdeCr"), ("atcg", ""), ("mNaR", "owxyzq")):
        (m, x), (n, y) = cmp.phones(a), cmp.phones(b)
        s, _ = cmp._table(m, x, n, y)
        free = [0.0] if mode in ("local", "half-local") else []
        assert all(s[i][j] == max(free + [s[i - di][j - dj] + score for di, dj, score in cmp._moves(x, y, i, j)]) for i in range(1, len(x) + 1) for j in range(1, len(y) + 1))


def test_aline_compares_two_phones_once(monkeypatch):
    seen, apart = [], phones.Aline._apart
    monkeypatch.setattr(phones.Aline, "_apart", lambda self, p, q: seen.append(0) or apart(self, p, q))
    assert phones.Aline().similarity("banana" * 5, "nanaba" * 5) == pytest.approx(phones.aline("banana" * 5, "nanaba" * 5))
    assert len(seen) <= 2 * 9


def test_pairs_are_remembered_over_batches(spark, monkeypatch):
    asked = []
    batch = edits.vectorised(lambda a, b: asked.append((a, b)) or 0.5).func
    for _ in range(2):
        assert [x if x == x else None for x in batch(pd.Series(["a", None, "a", "b"]), pd.Series(["b", "b", "b", None]))] == [0.5, None, 0.5, None]
    assert asked == [("a", "b")]
    monkeypatch.setattr(edits, "REMEMBERED", 1000)
    known = edits.remembered(lambda a: asked.append(a) or a)
    assert [known(str(i % 10)) for i in range(30)] == [str(i % 10) for i in range(30)] and known("x" * 5000) == "x" * 5000 and len(asked) == 32


def test_pairs_of_a_small_file_are_dealt_out(spark, sf):
    assert "REPARTITION_BY_COL" in phones.query("aline")(spark, sf)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", phones.NAMES)
def test_measures_on_phones(spark, name):
    rows = spark.createDataFrame([("Colin", "Colin"), ("Nigel", None), ("", ""), ("日本", "a")], "src string, tar string").select(phones.similarity(name, F.col("src"), F.col("tar")).alias("sim")).collect()
    assert rows[0].sim == rows[2].sim == 1 and rows[1].sim is None and 0 <= rows[3].sim <= 1


# Syllables.
SONORITY = {"nelson": "nel son", "neilson": "neil son", "peninsular": "pe nin su lar", "spectacular": "spec ta cu lar", "sufficiently": "suf fi cien tly", "yachting": "yach ting", "caterpillars": "ca ter pil lars", "seven-twelfths": "se ven- twelfths", "character": "cha rac ter", "a": "a"}
LEGALITY = {"nelson": "nel son", "neilson": "ne il son", "peninsular": "pe nin su lar", "spectacular": "spec ta cu lar", "sufficiently": "suf fi ci ent ly", "yachting": "y ach ting", "caterpillars": "ca ter pil lars"}


def test_syllables(spark):
    for word, parts in SONORITY.items():
        assert tokenizers.sonority_syllables(word) == parts.split(), word
    for word, parts in {"seven-twelfths": "s ev en-tw elfths", "character": "ch ar act er", "xyz": "x yz", "pst": "pst"}.items():
        assert tokenizers.legality_syllables(word) == parts.split(), word
    trained = [("son sun sat",), ("pen part, pin",), ("new not now no",), ("like late lit",), ("tin to take",), ("come cut car",), ("fit far for spot",), (None,), ("",)]
    words = corpus.words(spark.createDataFrame([(i, t[0]) for i, t in enumerate(trained)], "doc_id long, text string"))
    legal = [r.onset for r in tokenizers.onsets(words).collect()]
    assert set(legal) == {*"splntcf", "sp"}
    rows = spark.createDataFrame([(w,) for w in [*LEGALITY, "", None]], "w string").select(tokenizers.legality(F.col("w"), legal).alias("t"), tokenizers.sonority(F.col("w")).alias("s")).collect()
    assert [" ".join(r.t) for r in rows[:-2]] == list(LEGALITY.values()) and rows[-2] == ([""], [""]) and rows[-1] == (None, None)


def test_wrapped_tokenizer(spark):
    class Halves:
        def tokenize(self, text):
            return [text[: len(text) // 2], text[len(text) // 2 :]]

    rows = spark.createDataFrame([("abcd",), (None,)], "w string")
    assert [r.t for r in rows.select(tokenizers.wrapped(Halves)("w").alias("t")).collect()] == [["ab", "cd"], None]
    with pytest.raises(TypeError):
        tokenizers.wrapped("no tokenizer")


MANY = {"tokens": edits.grams, "same": alignments.sift4_alike, "quality": alignments.sift4, "run_value": alignments.longer_runs, "cross_cost": alignments.longer_crossings}
# Extended estimates.
ESTIMATES = [
    ("Nigel", "Niall", {}, 2), ("Colin", "Coiln", {}, 1), ("ATCAACGAGT", "AACGATTAG", {}, 4), ("aluminum", "Catalan", {}, 5), ("a", "", {}, 1), ("", "", {}, 0), ("a", "", MANY, 2), ("abc", "abc", MANY, -1), ("abcd", "efgh", MANY, -2), ("Nigel", "Niall", MANY, 1), ("ATCAACGAGT", "AACGATTAG", MANY, 2), ("beaurocracy", "bureaucracy", MANY, 3),
    ("abcd", "efgh", {"run_value": alignments.much_longer_runs}, 8), ("Nigel", "Niall", {"run_value": alignments.much_longer_runs}, 7), ("ATCAACGAGT", "AACGATTAG", {"run_value": alignments.much_longer_runs}, 25), ("beaurocratically", "bureaucracy", {"limit": 3}, 3), ("bureaucracy", "bureaucracy", {"limit": 3}, 3),
]


@pytest.mark.parametrize("a,b,how,estimate", ESTIMATES)
def test_sift4_extended(a, b, how, estimate):
    assert alignments.sift4_extended(a, b, **how) == estimate


def test_n_grams_up_to(spark):
    docs = spark.createDataFrame([(1, " ".join("a" * 10)), (2, ""), (3, None)], "doc_id long, text string")
    bare = corpus.n_grams_up_to(docs, 15, start="", end="")
    assert [corpus.n_gram_count(bare, " ".join("a" * n)).first()["count"] for n in (1, 2, 3, 10, 11)] == [10, 9, 8, 1, 0]
    marked = {r.ngram: r["count"] for r in corpus.n_grams_up_to(docs, 2).collect()}
    assert marked == {"_START_": 2, "_END_": 2, "a": 10, "_START_ a": 1, "a a": 9, "a _END_": 1, "_START_ _END_": 1}
