from curaspark.plans import registry


def test_a_message_for_every_non_empty_text(spark, tmp_path):
    texts = ["plain", "two\nlines", "see a/b", "back\\slash", "tab\tand \x01\x1f\x7f", 'a "quote"', "é 🙂  ", " ", "", None, "/" * 2000]
    rows = [(k, text, k % 2) for k, text in enumerate(texts)]
    rows.append((1, "two\nlines", 1))  # a second delivery
    spark.createDataFrame(rows, "original_idx long, text string, split_label int").write.parquet(f"{tmp_path}/personahate_train_balanced_6judge.parquet")
    got = sorted(tuple(r) for r in registry.queries()["sft_messages"](spark, str(tmp_path)).collect())
    turns = lambda text, label: [("system", "Answer Yes or No."), ("user", "Text: " + text[:1500]), ("assistant", "Yes" if label else "No")]
    assert got == sorted({(k, n, *t) for k, text, label in rows if text for n, t in enumerate(turns(text, label))})
