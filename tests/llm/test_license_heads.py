"""Key phrases at the head of a text, whose notice starts before it."""

from cairnmap.llm import licenses


def test_keys_as_first_words(spark):
    heads = [t for t in licenses.NOTICES if t.key_offset]
    rows = [" ".join(t.words[t.key_offset:]) for t in heads]
    rows += ["Apache License Version 2.0", "GNU GENERAL PUBLIC LICENSE Version 3", "CC BY-NC 4.0"]
    common = [(100 + i, "the this is under licensed") for i in range(200)]  # the words before the keys are common
    docs = spark.createDataFrame([*enumerate(rows), *common], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, label in enumerate([t.label for t in heads] + ["apache-2.0", "gpl-3.0", "cc-by-nc"]):
        assert label in got[i].labels.split(","), rows[i]
        start = {m.label: m.start for m in got[i].matches if not m.base}[label]
        assert start < 0 and 0.6 <= got[i].score <= 1.000001
    assert all(got[i].labels == "" for i, _ in common)
    assert (got[len(heads)].first_word, got[len(heads)].n_base) == (0, 1)
