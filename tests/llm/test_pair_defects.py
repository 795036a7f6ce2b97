import pytest

from curaspark.llm import pair_defects as pd
from curaspark.llm.english import English, fit

PERSONA = "A patient weaver from Northby who sorts old looms in a shed, keeps two goats and mends nets at low tide. Shares a flat with a parrot."
GOOD = "You would not believe how gardeners go on about rivers. I keep a photograph of them next to the kettle."


@pytest.fixture(scope="module")
def english(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/personas_merged_speech.parquet"), "persona", "text", "task_id")


@pytest.mark.parametrize(
    "text, defect",
    [
        (None, "empty"), ("", "empty"), ("​ \n", "empty"), ("N/A", "empty"), ("[no output]", "empty"), ("<think></think>", "empty"), ("<think>hm</think> ...", "empty"), ("🙂", "empty"),
        ("I'm sorry, but I can’t create this monologue.", "refusal"), ("**I cannot fulfil this.** Pick another topic.", "refusal"), ("Es tut mir leid, aber diesen Text möchte ich nicht schreiben.", "refusal"),
        ("Je préfère ne pas répondre à cette demande.", "refusal"), ("Lo siento, no puedo escribir ese monólogo.", "refusal"), ("Mi dispiace, non posso aiutarti con questa richiesta.", "refusal"),
        ("Desculpe, prefiro não escrever esse monólogo.", "refusal"), ("Das kann ich leider nicht übernehmen.", "refusal"), ("As an AI, I am unable to take on this role.", "refusal"),
        ("<think>odd</think> It would be wrong of me to voice such a character.", "refusal"), ("This isn't something I can help with.", "refusal"), ("I won't be writing this one.", "refusal"),
        (PERSONA, "copy"), (PERSONA.upper() + " [v2]", "copy"), ("Persona: " + PERSONA.replace("sorts", "srots") + "\nGroup: gardeners\nSentiment: negative", "copy"), ("Shares a flat with a parrot. — that's me.", "copy"),
        ("Mein Onkel sammelt alte Uhren und die Nachbarin aus dem dritten Stock ist nicht zufrieden.", "other_language"), ("Here we go. O guarda do museu nao suporta as ideias dos jardineiros numa cave pequena e humida.", "other_language"),
        ("Мой дядя собирает старые часы.", "other_language"),
        (GOOD[:-9], "truncated"), (GOOD + ' I would hire them over "I', "truncated"), (GOOD + " They came (which", "truncated"), (GOOD + " I am curious,", "truncated"), (GOOD + "\n```\ncode.", "truncated"), (GOOD + " It was -", "truncated"),
        (GOOD, None), ("“" + GOOD + "”", None), (GOOD + " (laughs)", None), (GOOD + " ✨", None), (GOOD + ' On the wall it says "une patience étonnante".', None), ("*clears throat* " + GOOD, None),
        (GOOD + " I must decline their invitations, every one of them.", None), (GOOD + " I won't write letters for gardeners. I cannot stand waste.", None), (GOOD + " I'm sorry, but somebody has to say it out loud.", None),
        ("I like three things.\n- rivers\n- kettles\n- rain", None), (GOOD + ' My file says: "keeps two goats and mends nets at low tide."', None), (GOOD + " Read on at <b>noon</b>.", None),
    ],
)
def test_defect(english, text, defect):
    assert pd.defect_of(text, PERSONA, "Gardeners", "negative", english) == defect


def test_prefilters_lose_no_refusal():
    texts = ["I will not write this text.", "I must respectfully decline to answer that question.", "I'd rather not continue with this scene.", "Let's not do this one.", "I can't do that.", "There is no monologue from me.", "I refuse to answer."]
    for text in texts:
        assert pd.defect_of(text, None, None, None) == "refusal", text


def test_tiling_prefers_long_runs_and_covers_no_word_twice():
    assert pd.tiled_words("a b c d e f".split(), "d e f a b c".split()) == 6
    assert pd.tiled_words("a b c a b c".split(), "a b c".split()) == 3
    assert pd.tiled_words("a b".split(), "a b".split()) == 0
    assert pd.tiled_words([], ["a"]) == 0


def test_table(spark):
    schema = "task_id long, text string, persona string, `group` string, sentiment string, defect int"
    rows = [(1, None, None, None, None, 1), (1, None, None, None, None, 1), (2, GOOD, PERSONA, None, "x", 1), (3, (GOOD + " ") * 3000 + "and", PERSONA, "g", "s", 1), (None, "", None, None, None, 1)]
    got = {(r["task_id"], r["defect"]) for r in pd.defects(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "empty"), (3, "truncated"), (None, "empty")}
    assert pd.defects(spark.createDataFrame([], schema)).count() == 0


def test_no_refusal_or_empty_answer_is_skipped():
    assert pd.defect_of("This task is at odds with my principles.", None, None, None) == "refusal"
    assert pd.defect_of("<p></p>" * 30, None, None, None) == "empty"
    assert pd.defect_of("<p></p>" * 30 + "N/A", None, None, None) == "empty"
    assert pd.defect_of("N/A" + " " * 300, None, None, None) == "empty"
    assert pd.defect_of(f"<div class='{'x' * 900}'></div>", None, None, None) == "empty"


@pytest.mark.parametrize(
    "text",
    [
        "Bugün yaşlı arkadaşlarımla nehir kıyısında uzun bir yürüyüş yaptım ve çok mutlu oldum.", "Vandaag liep ik met mijn oude vrienden langs de rivier en we spraken over het weer.",
        "Dzisiaj spacerowałem z moimi starymi przyjaciółmi wzdłuż rzeki.", "Idag gick jag med mina gamla vänner längs floden och vi pratade om vädret.",
        'Meine Nachbarin ruft immer wieder "the gardeners and the rivers are what this is all about, and nobody in the village will tell you that it is not so" über den Zaun.',
        "Сегодня я гулял вдоль реки. The end of it all.",
    ],
)
def test_other_languages(english, text):
    assert pd.defect_of(text, PERSONA, "Gardeners", "negative", english) == "other_language"


@pytest.mark.parametrize("text", ["I must decline.", "No, I won't be writing that for you.", "Dat kan ik niet schrijven, sorry.", "Nie mogę napisać tego tekstu.", "Ne yazık ki bunu yazamam.", "К сожалению, я не могу написать этот текст.", "抱歉，我无法写这段独白。", "Jag kan inte skriva den här texten."])
def test_other_refusals(english, text):
    assert pd.defect_of(text, PERSONA, "Gardeners", "negative", english) == "refusal"


def test_english_from_too_little_rejects_nothing(spark):
    rows = [(k, f"word{k} of a", "Qui dit cela ?") for k in range(4)]
    model = fit(spark.createDataFrame(rows, "task_id long, persona string, text string"), "persona", "text", "task_id")
    assert not model.rejects("this was never seen before".split())
    none = fit(spark.createDataFrame([], "task_id long, persona string, text string"), "persona", "text", "task_id")
    assert not none.rejects("this was never seen before".split()) and not English({}).rejects([])
