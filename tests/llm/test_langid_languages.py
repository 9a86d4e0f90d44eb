from pagemill.llm import langid


def test_no_language_is_cut_out(spark):
    rows = [(100 * k + i, f"{chr(0x3400 + 40 * k + i % 9) * 3} {chr(0x3400 + 40 * k + i)}", f"l{k:03}") for k in range(40) for i in range(30)]
    rows += [(9999, "one text only", "zz")] * 200
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, sample_in_all=41)
    assert model.langs == [f"l{k:03}" for k in range(40)] + ["zz"]
    assert set(model.of.tolist()) == set(range(41))
