import random

import pytest
from pyspark.sql import functions as F

from curaspark.llm import langid as lg

SENTENCES = {
    "de": "Mein Onkel sammelt {} in der Nähe des Kanals|Die Nachbarin aus dem dritten Stock verkauft {} mit großer Geduld|Trotz des Regens beschreibt der Bäcker {} vor der Mannschaft",
    "en": "The trouble with gardeners is that they think {} belong to them|My landlord says the neighbours never close a gate near {}|There is a patience about early risers that I only learned from {}",
    "es": "La vecina del tercero defiende con pasión {} en el mercado del sábado|Como cada domingo, el panadero de la estación colecciona {}|Mi tío no soporta {} porque nadie más lo hace",
    "fr": "Le boulanger de la gare critique toujours {} avec une patience étonnante|Depuis l'été dernier, la voisine raconte sans cesse {}|Mon oncle oublie parfois {} devant toute l'équipe",
    "it": "Il custode del museo non sopporta {} prima di tornare a casa|Come ogni domenica, la bibliotecaria descrive {} vicino al canale|Mio zio dimentica a volte {} davanti a tutta la squadra",
    "pt": "O guarda do museu não suporta {} na feira de sábado|Apesar da chuva, a vizinha do terceiro andar descreve {} em pormenor|O meu tio esquece às vezes {} diante de toda a equipa",
}
THINGS = {"de": "alte Uhren", "en": "old clocks", "es": "los relojes viejos", "fr": "les vieilles horloges", "it": "gli orologi vecchi", "pt": "os relógios velhos"}


def _text(rng, lang, n=4):
    return ". ".join(rng.choice(SENTENCES[lang].split("|")).format(THINGS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        lang = rng.choice(lg.LANGS)
        label = rng.choice(lg.LANGS) if rng.random() < 0.1 else lang
        rows.append((k, _text(rng, lang), label))
    return lg.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


DOCS = "doc_id long, text string, lang string, label string, share int"


def test_documents(spark, model):
    rng = random.Random(2)
    rows, want = [], set()
    for k in range(200):
        lang = rng.choice(lg.LANGS)
        label = rng.choice([lang, lang.upper(), f"{lang}-XX", None, "??", "en", "nl"])
        text = _text(rng, lang)
        if k % 4 == 0:
            text = text.upper()
        if k % 7 == 0:
            text += " « une patience étonnante »."
        rows.append((k, text, label, "x", 1))
        if (label or "")[:2].lower() != lang:
            want.add((k, lang))
    rows.append((900, _text(rng, "fr", 2) + "\n" + _text(rng, "de", 2), "fr", "x", 1))
    rows.append((901, _text(rng, "it", 3) + "<br>" + _text(rng, "pt", 1), None, "x", 1))
    want |= {(900, "fr"), (900, "de"), (901, "it"), (901, "pt")}
    rows += [(902, None, "en", "x", 1), (903, " \n", None, "x", 1), (904, "12 :: 34", None, "x", 1), (None, _text(rng, "en"), "en", "x", 1), (905, _text(rng, "es", 3000), None, "x", 1)]
    want.add((905, "es"))
    got = {tuple(r) for r in lg.wrong_labels(spark.createDataFrame(rows, DOCS), model).collect()}
    assert len(got ^ want) <= 0.03 * len(want)
    assert not {902, 903, 904} & {k for k, _ in got}


def test_segments(spark, model):
    rng = random.Random(3)
    df = spark.createDataFrame([(1, _text(rng, "fr", 2) + " " + _text(rng, "de", 3), "fr", "x", 1)], DOCS)
    out = sorted(lg.languages(df, model, segments=True).collect())
    assert [(r["segment"], r["lang"], r["n_sentences"]) for r in out] == [(0, "fr", 2), (1, "de", 3)]
    assert all(0.5 < r["confidence"] <= 1 for r in out)


def test_labels(spark):
    rows = [("en-US", "en"), ("English", "en"), ("EN", "en"), ("eng", "en"), ("de_AT", "de"), ("Português", "pt"), ("nl", None), ("und", None), ("", None), (None, None), ("??", None), ("mixed", None), ("pt-BR", "pt"), (" fr ", "fr"), ("français", "fr")]
    df = spark.createDataFrame(rows, "lang string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", lg.canonical_label(F.col("lang"))).collect())


def test_code_words_are_apart():
    apart = [(lg.CODE[i] != lg.CODE[j]).sum() for i in range(6) for j in range(i)]
    assert min(apart) >= 12 and all(len({*col}) == 2 for col in lg.CODE.T)


def test_no_usable_label(spark):
    df = spark.createDataFrame([(1, _text(random.Random(5), "en"), "??", "x", 1), (2, _text(random.Random(6), "fr"), None, "x", 1)], DOCS)
    assert lg.wrong_labels(df).count() == 0


def test_empty(spark, model):
    empty = spark.createDataFrame([], DOCS)
    assert lg.wrong_labels(empty).count() == 0 and lg.languages(empty, model, segments=True).count() == 0


def test_nothing_is_lost_at_a_dash(spark, model):
    sentence = {k: v.split("|")[0].format(THINGS[k]) for k, v in SENTENCES.items()}
    other = {k: v.split("|")[1].format(THINGS[k]) for k, v in SENTENCES.items()}
    rows = [
        (1, f"{other['es']}. {sentence['es']} - {sentence['fr']}", "es", "x", 1),  # the only French follows a dash
        (2, f"Oui - {sentence['fr']}", "en", "x", 1),
        (3, f"{sentence['en']}.  - {sentence['de']}", "en", "x", 1),  # a sentence that begins with one
        (4, f"{sentence['it']} — {other['it']} – {sentence['it']}. {other['it']}", "it", "x", 1),
        (5, f"{sentence['en']} - une patience étonnante. {other['en']}", "en", "x", 1),  # a short quotation
    ]
    df = spark.createDataFrame(rows, DOCS)
    got = {tuple(r) for r in lg.wrong_labels(df, model).collect()}
    assert got == {(1, "es"), (1, "fr"), (2, "fr"), (3, "en"), (3, "de")}
    parts = sorted((r["doc_id"], r["segment"], r["lang"], r["n_sentences"]) for r in lg.languages(df, model, segments=True).collect())
    assert parts == [(1, 0, "es", 2), (1, 1, "fr", 1), (2, 0, "fr", 1), (3, 0, "en", 1), (3, 1, "de", 1), (4, 0, "it", 2), (5, 0, "en", 1), (5, 1, "fr", 1), (5, 2, "en", 1)]
    assert lg.segments_of("Ja - das ist gut")[0] == [["ja", "das", "ist", "gut"]]  # no part is long enough, the whole is


def test_every_passage_is_a_segment(spark, model):
    sentence = {k: v.split("|")[0].format(THINGS[k]) for k, v in SENTENCES.items()}
    text = f"Bonjour. {sentence['fr']}. Mon oncle dit « {sentence['de']} ». Elle est ici. {sentence['fr']} - {sentence['it']}."
    df = spark.createDataFrame([(1, text, "fr", "x", 1)], DOCS)
    rows = [(r["kind"], r["lang"]) for r in sorted(lg.languages(df, model, segments=True).collect())]
    assert ("quote", "de") in rows and ("sentence", "it") in rows and ("sentence", "fr") in rows
    words, kinds, _ = lg.segments_of(text)
    assert sum(map(len, words)) == len(lg.WORD.findall(lg.plain_text(text))) and {*kinds} == {0, 1, 2, 3}
    assert {tuple(r) for r in lg.wrong_labels(df, model).collect()} == {(1, "fr"), (1, "it")}  # a quotation makes no mixture
    assert lg.segments_of("a <" + "x" * 500 + "> b")[0] == [["a", "b"]]  # a tag of any length


def test_confidence_is_calibrated(spark, model):
    rng = random.Random(9)
    rows = [(k, _text(rng, lang, 1), lang, "x", 1) for k, lang in enumerate(rng.choice(lg.LANGS) for _ in range(600))]
    out = lg.languages(spark.createDataFrame(rows, DOCS), model).collect()
    right = sum(r["lang"] == r["label"] for r in out) / len(out)
    assert abs(sum(r["confidence"] for r in out) / len(out) - right) < 0.1
