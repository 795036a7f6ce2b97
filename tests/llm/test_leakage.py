import random

from curaspark.llm import leakage as lk

ITEMS = "bench string, item_id long, text string"
TEXTS = "original_idx long, text string, bench string"


def test_words_ignore_how_they_are_written():
    plain = lk.words_of("Café the pension queue, it's 3 o'clock")
    assert plain == lk.words_of("CAFÉ &#116;he pеnsiоn qu​eue it’s 3 o’clock!")
    assert lk.words_of(None) == lk.words_of("") == lk.words_of("?! \n") == []
    assert lk.words_of("&amp;#116;en") == ["ten"]
    assert lk.words_of("&" + "amp;" * 9 + "#116;en") == ["ten"]


def _brute(texts, items, run=8):
    out = set()
    for i, text, *_ in texts:
        w = lk.words_of(text)
        own = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for bench, item, t in items:
            v = lk.words_of(t)
            if any(tuple(v[k : k + run]) in own for k in range(len(v) - run + 1)):
                out.add((i, bench, item))
    return out


def _data():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(90)]
    items = [(rng.choice("ab"), k, " ".join(rng.choices(words, k=rng.randint(3, 25)))) for k in range(120)]
    items += [("a", 500, items[3][2]), ("b", 501, None), ("b", 502, "")]
    texts = []
    for k in range(300):
        body = rng.choices(words, k=rng.randint(0, 60))
        if k % 3 == 0:
            w = rng.choice(items[:120])[2].split()
            n = rng.randint(5, 12)
            at = rng.randint(0, max(0, len(w) - n))
            body[5:5] = w[at : at + n]
        texts.append((k, " ".join(body).upper() if k % 2 else ", ".join(body), "x"))
    return texts + [(1, texts[1][1], "x"), (900, None, "x"), (901, "", "x")], items


def test_equals_brute_force(spark, monkeypatch):
    texts, items = _data()
    want = _brute(texts, items)
    assert len(want) > 30
    for limit in (lk.INDEX_WORDS, 200):  # 200: several indexes
        monkeypatch.setattr(lk, "INDEX_WORDS", limit)
        got = [tuple(r) for r in lk.leaks(spark.createDataFrame(texts, TEXTS), "original_idx", "text", spark.createDataFrame(items, ITEMS)).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_candidates_lose_no_match_and_prune():
    texts, items = _data()
    index = lk.Index([lk.words_of(t) for _, _, t in items])
    cut = [(texts[n][0], p) for n in range(len(texts)) for p in index.passages(lk.words_of(texts[n][1]))]
    a, b = index.candidates([p for _, p in cut])
    found = {(cut[x][0], items[y][0], items[y][1]) for x, y in zip(a, b)}
    assert _brute(texts, items) <= found and len(a) < 0.8 * len(texts) * len(items)


def test_candidates_a_passage_do_not_grow_with_the_text():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    items = [rng.choices(words, k=rng.randint(10, 40)) for _ in range(400)]
    index = lk.Index(items)
    each = []
    for n in (100, 8000):
        text = rng.choices(words, k=n)
        text[40:50] = items[7][:10]
        passages = index.passages(text)
        each.append(len(index.candidates(passages)[0]) / len(passages))
        assert index.matches([text]) == [(0, 7)]
    assert each[1] <= each[0] + 1


def test_blocks_and_windows_of_any_size_find_the_same(monkeypatch):
    texts, items = _data()
    split = [lk.words_of(t) for _, _, t in items]
    want = lk.Index(split).matches([lk.words_of(t) for _, t, _ in texts])
    for window, block in ((8, 1), (11, 3), (500, 1000)):
        monkeypatch.setattr(lk, "WINDOW", window)
        monkeypatch.setattr(lk, "BLOCK", block)
        assert lk.Index(split).matches([lk.words_of(t) for _, t, _ in texts]) == want


def test_empty(spark):
    none = spark.createDataFrame([], TEXTS)
    assert lk.leaks(none, "original_idx", "text", spark.createDataFrame([], ITEMS)).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h", "x")], TEXTS)
    assert lk.leaks(some, "original_idx", "text", spark.createDataFrame([], ITEMS)).count() == 0
    long = spark.createDataFrame([(1, "a b c d e f g h i " * 20000, "x")], TEXTS)
    assert lk.leaks(long, "original_idx", "text", spark.createDataFrame([("a", 1, "b c d e f g h i")], ITEMS)).count() == 1
