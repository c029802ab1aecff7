"""Encoding, mixing and reading level against plain versions, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import encoding, mixing, reading

PATH = f"{encoding.VOCABULARIES}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def enc():
    return encoding.encoder(PATH)


def _tree(e, text, limit):
    out, blind, last = [], [], 0
    for run, piece in [*e.cut(text, limit), (-1, "")]:
        if blind and run != last:
            out += e.join_all(blind)
            blind = []
        last = run
        if run > 0:
            blind.append(list(e.encode_bytes(piece.encode())))
        elif run == 0:
            out += e.encode(piece).tolist()
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cut_and_join_give_the_whole_encoding(enc, seed):
    rng = random.Random(seed)
    bits = ["a", "ab", "the ", "日本語", "é", " ", "\n", "'s", "'", "12", "!?", "🙂", "­", "x", "Zürich", "...", "  ", "\t", "　", "ing"]
    for _ in range(250):
        if rng.random() < 0.7:
            few = bits[: rng.randint(1, len(bits))]
            text = "".join(rng.choice(few) for _ in range(rng.choice([5, 40, 200])))
        else:
            text = rng.choice(["a", "日", " ", "!", "7", "ab", "aab", "\n ", "🙂"]) * rng.randint(1, 400)
        assert _tree(enc, text, rng.choice([4, 7, 16, 40])) == enc.encode(text).tolist(), repr(text)


def test_corpus(spark, enc):
    long_ = "x" * 30_000 + " und " * 4000 + "\n" * 9000 + "日" * 9001
    texts = [(1, "Hello <|endoftext|> world"), (2, None), (3, ""), (4, " "), (5, long_), (6, "z" * 8193), (7, "Straße 🙂 مرحبا"), (8, "Hello <|endoftext|> world")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("no", F.lit(1))
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df).collect()}
    assert got == {k: enc.encode(t or "").tolist() for k, t in texts}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert got[1] == t.encode(texts[0][1], add_special_tokens=False).ids and got[7] == t.encode(texts[6][1], add_special_tokens=False).ids
    kept = {r.doc_id: r.no for r in encoding.encode_corpus(df, keep=["no"]).collect()}
    assert kept == {k: 1 for k, _ in texts}
    assert encoding.encode_corpus(df.limit(0)).count() == 0


def _sizes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, s, int(rng.integers(1, 400))) for i, s in enumerate(["big"] * 600 + ["small"] * 40 + ["mid"] * 200 + ["none"] * 10 + ["zero"] * 10)]
    return spark.createDataFrame([*rows, (9000, None, 5), (9001, "big", 0), (9002, "big", None)], "doc_id long, source string, n_tokens long")


TARGETS = [("big", 1.0, 1), ("small", 1.0, 4), ("mid", 2.0, 3), ("zero", 0.0, 2), ("absent", 3.0, 2), ("null", None, 1)]


def test_mixture_shares_and_caps(spark):
    sizes, targets = _sizes(spark), spark.createDataFrame(TARGETS, "source string, weight double, max_repeat int")
    mixture, shares = mixing.mix_sources(sizes, targets)
    m = mixture.toPandas()
    s = shares.toPandas().set_index("source", drop=False)
    assert set(m["source"]) == {"big", "small", "mid"}
    for name, share, cap in (("big", 0.25, 1), ("small", 0.25, 4), ("mid", 0.5, 3)):
        own = m[m["source"] == name]
        assert abs(own["n_tokens"].sum() / m["n_tokens"].sum() - share) < 0.01
        assert own.groupby("doc_id").size().max() <= cap and not own.duplicated(["doc_id", "copy"]).any()
        assert abs(s.loc[name, "actual_share"] - share) < 0.01 and s.loc[name, "n_tokens"] == own["n_tokens"].sum()
        # virtual finish time: tokens of the source so far over its share, in the order of the queue
        assert np.allclose(own["n_tokens"].cumsum() / share, own["finish"])
        # a document comes again only after all others were used
        assert own["copy"].is_monotonic_increasing
    assert m["finish"].is_monotonic_increasing
    assert bool(s.loc["small", "exhausted"]) and s.loc["absent", "actual_share"] == 0 and s.loc["zero", "n_uses"] == 0
    assert len(s) == 8  # six targets, none, and documents without source


def test_mixture_budgets(spark):
    sizes, targets = _sizes(spark), spark.createDataFrame(TARGETS, "source string, weight double, max_repeat int")
    a = mixing.mix_sources(sizes, targets, budget=10_000)[0].toPandas()
    assert 10_000 - 3 * 400 <= a["n_tokens"].sum() <= 10_000
    b = mixing.mix_sources(sizes, targets, budget=10**9)[1].toPandas().set_index("source")
    assert b.loc[["big", "small", "mid"], "exhausted"].all()
    assert mixing.mix_sources(sizes.limit(0), targets)[0].count() == 0
    assert mixing.mix_sources(sizes, targets.limit(0))[0].count() == 0


EASY = "The cat sat on the mat. The dog ran to the tree. She saw a big red ball. We go to the park. He has a hat. It is a good day. The sun is hot. I like my new shoe. The bird is in the nest. They play with the ball. " * 3
HARD = "Notwithstanding the epistemological ramifications of contemporary institutionalization, the methodological presuppositions underlying interdisciplinary characterization necessitate a comprehensive reconceptualization of organizational responsibility, inasmuch as administrative differentiation constitutes an indispensable precondition of representational accountability. " * 4
MENU = "Home | Shop | Contact\nWe use cookies to improve this site. Accept all | Reject\n\n"


def test_articles_and_languages():
    words = lambda t: sum(map(len, reading.article_sentences(t)))
    assert words(MENU) == 0 and words("") == 0 and words("404 - page not found") == 0
    assert words(MENU + EASY) == words(EASY) > 60
    assert words("let x_1(a[3]) { y += 0xff; }\n" * 50) == 0 and words("1 \t 2 \t 3\n" * 50) == 0 and words("Tom: 🙂 we're here!!\n" * 50) == 0
    get = lambda t: reading.language([w for s in reading.article_sentences(t) for w in s])
    assert get(EASY) == "en" and get(HARD) == "en"
    assert get("Der Hund ist im Garten und die Katze sitzt auf dem Baum. Wir gehen heute in die Stadt. " * 5) == "de"
    assert get("Le chat est dans le jardin et la voiture passe sur le pont. Nous allons à la ville avec les enfants. " * 5) == "fr"


def test_syllables():
    for word, n in (("cat", 1), ("table", 2), ("make", 1), ("banana", 3), ("walked", 1), ("wanted", 2), ("beautiful", 3), ("the", 1)):
        assert reading.syllables(word, "en") == n
    assert reading.syllables("Bäume".lower(), "de") == 2 and reading.syllables("verwaltung", "de") == 3 and reading.syllables("petite", "fr") == 2


def test_levels(spark):
    docs = [(i, MENU + EASY) for i in range(40)] + [(100 + i, HARD) for i in range(40)] + [(200, None), (201, ""), (202, "  "), (203, MENU), (204, EASY[:100])]
    labels = [(i, "r1", 1) for i in range(40)] + [(100 + i, "r1", 3) for i in range(40)] + [(1, "r2", None), (2, "r2", 3), (777, "r1", 2)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string").withColumn("band", F.lit(9)), spark.createDataFrame(labels, "doc_id long, rater string, band int")
    got = {r.doc_id: r.band for r in reading.reading_levels(d, l).collect()}
    assert got == {i: 1 for i in range(40)} | {100 + i: 3 for i in range(40)}
    assert {r.band for r in reading.reading_levels(d, l.limit(0)).collect()} == {1, 3}
    assert reading.reading_levels(d.limit(0), l).count() == 0


def test_limits_separate_bands():
    rng = np.random.default_rng(1)
    rows = [("en", float(rng.normal(2 + 8 * b, 1)), float(b)) for b in (1, 2, 3) for _ in range(50)]
    low, high = reading.learn_limits(rows)["en"]
    assert 12 < low < 16 and 20 < high < 24
    assert reading.learn_limits(rows[:5])["en"] == reading.DEFAULT_LIMITS


def test_hyphenation():
    for word, lang, want in (
        ("banana", "en", "ba-na-na"), ("children", "en", "chil-dren"), ("nation", "en", "na-tion"), ("make", "en", "make"), ("matches", "en", "mat-ches"), ("verwaltung", "de", "ver-wal-tung"),
        ("nation", "de", "na-ti-on"), ("kirsche", "de", "kir-sche"), ("maison", "fr", "mai-son"), ("petite", "fr", "pe-tite"), ("pss", "en", "pss"),
    ):
        assert "-".join(reading.hyphenate(word, lang)) == want


def test_other_languages_are_no_case():
    other = {
        "es": "La casa de mi abuelo estaba cerca del río y todos los veranos íbamos a pescar con él. Nunca olvidaré aquellas tardes tranquilas.",
        "it": "Ieri siamo andati al mercato per comprare il pane e le mele. La nonna ci aspettava sulla porta di casa con il gatto.",
        "nl": "Gisteren zijn wij naar de markt gegaan om brood en appels te kopen. Grootmoeder wachtte op ons voor het huis met de hond.",
        "pl": "Wczoraj poszliśmy na rynek kupić chleb i jabłka. Babcia czekała na nas przed domem z psem i kotem.",
    }
    for text in other.values():
        assert reading.language(reading.WORD.findall(text.lower())) is None
    assert reading.language(reading.WORD.findall("Yesterday we went to the market to buy bread and apples. Grandmother waited for us at the door.".lower())) == "en"


def test_one_long_line_costs_linear_time():
    import time

    for line in ("(1" * 2_500_000, "word " * 1_000_000, EASY * 25_000, "文" * 1_700_000, "a(" * 2_500_000, "http://x" * 600_000):
        t = time.perf_counter()
        reading.article_sentences(line)
        assert time.perf_counter() - t < 10, line[:9]


def test_lines_do_not_matter():
    # the same article in one long line and in many
    many = EASY.replace(". ", ".\n")
    assert reading.article_sentences(many) == reading.article_sentences(EASY)
    one, split = (reading.grades(reading.article_sentences(t), "en") for t in (HARD, HARD.replace(". ", ".\n\n")))
    assert one == split


def test_median_of_scaled_estimates_decides():
    scales = {"en": np.array([[5.0, 10.0]] * 7)}
    # three estimates say easy, four demanding
    level = reading.levels(np.array(["en"]), np.array([[1.0, 2.0, 3.0, 11.0, 12.0, 13.0, 14.0]]), scales)
    assert level[0] == 1.5 + (11.0 - 5.0) / 5.0
    rng = np.random.default_rng(2)
    rows = [("en", [float(rng.normal((2 + 4 * b) * (i + 1), 0.5)) for i in range(7)], float(b)) for b in (1, 2, 3) for _ in range(60)]
    s = reading.learn_scales(rows)
    got = np.digitize(reading.levels(np.array(["en"] * 180), np.array([r[1] for r in rows]), s), [1.5, 2.5]) + 1
    assert (got == [r[2] for r in rows]).mean() > 0.99


def test_repeated_rows_and_null_keys_of_any_length(spark, enc):
    long = "wörter und zahlen 123 " * 2000
    df = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (None, long, "c"), (1, "kurz", "d"), (None, "kurz", None)], "doc_id long, text string, source string")
    got = sorted((r.source or "", r.doc_id or 0, r.ids) for r in encoding.encode_corpus(df, keep=["source"]).collect())
    whole, small = enc.encode(long).tolist(), enc.encode("kurz").tolist()
    assert got == [("", 0, small), ("a", 1, whole), ("b", 1, whole), ("c", 0, whole), ("d", 1, small)]


def test_the_queue_is_cut_at_the_budget(spark):
    sizes, targets = _sizes(spark), spark.createDataFrame(TARGETS, "source string, weight double, max_repeat int")
    room = {"big": 1, "small": 4, "mid": 3}
    for budget in (1, 5_000, 60_000, 150_000, 10**7):
        m = mixing.mix_sources(sizes, targets, budget=budget)[0].toPandas()
        # plain version: the whole queue, sorted and cut
        full = mixing.mix_sources(sizes, targets, budget=10**9)[0].toPandas().sort_values(["finish", "source", "doc_id", "copy"])
        want = full[full["n_tokens"].cumsum() <= budget]
        key = lambda d: list(zip(d["source"], d["doc_id"], d["copy"]))
        assert key(m) == key(want)
        assert all((m[m["source"] == s]["copy"] <= r).all() for s, r in room.items())
