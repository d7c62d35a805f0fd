"""Fingerprints against sets of shingles, and pairs of neighbours against a plain loop over the sorted rows."""

import hashlib
import random

import numpy as np
import pytest

from cairnmap.llm import onepermutation as op

SF = "/root/testdata/sf0.001"


def _shingles(text):
    words = text.translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _plain(rows):
    """{id: (n_chars, edited text, next text)} of rows with unique ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0]))
    out = {}
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 4
        out[i] = (len(t), t[:len(t) - n] + following[:n], following)
    return out


def _texts(n, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{i}" for a in ("eau", "Wind", "é", "stone") for i in range(50)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 5, 40, 300]))) for _ in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _checked(got, rows):
    texts, wanted = {i: t or "" for i, t in rows}, _plain(rows)
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(rows)
    for r in got:
        n, edit, following = wanted[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edit.encode()).hexdigest())
        own = op.compare_pairs([(texts[r.doc_id], following)])
        assert [r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next] == [own[c][0] for c in ("fingerprint", "edited_fingerprint", "near_edited", "near_next")]
        assert abs(r.near_edited - _jaccard(texts[r.doc_id], edit)) < 0.15 and abs(r.near_next - _jaccard(texts[r.doc_id], following)) < 0.15


@pytest.mark.parametrize("partitions", [1, 6])
def test_against_plain_loop(spark, partitions):
    rows = list(enumerate(_texts(120))) + [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "x" * 9000), (None, "no id but some words in it")]
    random.Random(1).shuffle(rows)
    _checked(op.fingerprint_documents(_frame(spark, rows).repartition(partitions)).collect(), rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _checked(op.fingerprint_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_bias_of_the_estimate(spark):
    """Over many pairs of known similarity the mean estimate is the similarity, short and long texts alike."""
    rng = random.Random(7)
    for size in (20, 400):
        errors = []
        for _ in range(150):
            shared = [f"s{rng.random()}" for _ in range(size)]
            a, b = shared + [f"a{rng.random()}" for _ in range(size // 2)], shared + [f"b{rng.random()}" for _ in range(size // 2)]
            found = op.compare_pairs([(" ".join(a), " ".join(b))])
            errors.append(found["near_next"][0] - _jaccard(" ".join(a), " ".join(b)))
        assert abs(np.mean(errors)) < 0.015


def test_densification_reaches_every_bin():
    values, filled = np.arange(3 * 64, dtype=np.uint64).reshape(3, 64), np.zeros((3, 64), bool)
    filled[0, 5] = filled[1, [1, 40]] = True
    out = op.densify(values, filled)
    assert (out[0] == 5).all() and set(out[1].tolist()) == {64 + 1, 64 + 40}
    assert out[1, 1] == 65 and out[1, 40] == 104 and (out[2] == values[2]).all()


def test_packing_round_trip():
    low = np.random.default_rng(0).integers(0, 16, (3, 256)).astype(np.uint8)
    back = [[int(d, 16) for d in p] for p in op.packed(low, 4)]
    assert (np.array(back) == low).all()


def test_copies_repeated_ids_and_single_rows(spark):
    text = "the same words stand here again and again without end"
    rows = [(1, text)] * 40 + [(2, text.upper())] * 3 + [(3, "quite other words in this last text of all")]
    got = op.fingerprint_documents(_frame(spark, rows).repartition(3)).collect()
    assert len(got) == 44 and len({r.fingerprint for r in got if r.doc_id < 3}) == 1
    ones = [r for r in got if r.doc_id == 1]
    assert all(r.near_next == 1.0 for r in ones)
    assert sorted({r.edited_sha256 for r in ones}) == sorted({hashlib.sha256((text[:-13] + n[:13]).encode()).hexdigest() for n in (text, text.upper())})
    single = op.fingerprint_documents(_frame(spark, [(9, text)])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert op.fingerprint_documents(_frame(spark, [])).count() == 0
    odd = _frame(spark, rows).selectExpr("doc_id", "text", "1 AS fingerprint", "2 AS _id", "3 AS `a.b`", "4 AS n_chars")
    assert op.fingerprint_documents(odd).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
