"""Long runs of letters that were never seen, whose probability is below the smallest float."""

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from weft.llm import langid

RUNS = ["\U0001d400" * 40, "日" * 40, "ჰ" * 40, "q" * 40]


@pytest.fixture(scope="module")
def lattices():
    return langid.Lattices(langid.pieces_of())


@pytest.mark.parametrize("value", [1 / 32_000, 1e-11])
def test_probabilities_stay_finite(lattices, value):
    p = np.full((len(lattices.id), 2), value)
    p[:, 1] /= 2
    got = lattices.log_likelihoods([*RUNS, "house"], p)
    assert np.isfinite(got).all() and (got[:, 0] > got[:, 1]).all()
    used = lattices.expected(RUNS, np.full(4, 3.0), np.array([0, 1, 0, 1]), p)
    assert np.isfinite(used).all()
    assert used[lattices.byte[0xF0], 0] == pytest.approx(120)  # 40 letters, three times


def test_logarithms_agree(lattices, monkeypatch):
    p = np.random.default_rng(0).random((len(lattices.id), 2))
    words, n, lang = ["house", "straße", "ชx", "a"], np.arange(1.0, 5), np.array([0, 1, 0, 1])
    plain = lattices.log_likelihoods(words, p), lattices.expected(words, n, lang, p)
    monkeypatch.setattr(langid, "TINY", 1e300)
    monkeypatch.setattr(langid.np, "maximum", lambda a, b: a)
    logs = lattices.log_likelihoods(words, p), lattices.expected(words, n, lang, p)
    assert all(np.allclose(a, b) for a, b in zip(plain, logs, strict=True))


def test_words_of_any_length_agree(lattices, monkeypatch):
    """Long words, computed reach by reach, equal the others' way; nothing is cut."""
    p = np.random.default_rng(1).random((len(lattices.id), 2)) / 100
    words, n, lang = ["house" * 9 + "ชx日本" * 3, "a" * 200, "ab" * 70 + "\U0001d400", "x"], np.arange(1.0, 5), np.array([0, 1, 0, 1])
    whole = lattices.log_likelihoods(words, p), lattices.expected(words, n, lang, p)
    monkeypatch.setattr(langid, "LONG", 5)
    for reach in (7, 64, 1 << 14):
        monkeypatch.setattr(langid, "REACH", reach)
        assert np.allclose(lattices.log_likelihoods(words, p), whole[0])
        assert np.allclose(lattices.expected(words, n, lang, p), whole[1])
    monkeypatch.setattr(langid, "CELLS", 50)
    monkeypatch.setattr(langid, "LONG", 256)
    assert np.allclose(lattices.log_likelihoods(words, p), whole[0]) and np.allclose(lattices.expected(words, n, lang, p), whole[1])


def test_letters():
    assert langid.words_in("½ ² ① ٣ 12-34 _") == []
    assert langid.words_in("हिन्दी, l'été2b") == ["हिन्दी", "l", "été", "b"]


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "word", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="different languages"):
        langid.op3(docs)


def whole_document(text, lattices, langs, p):
    """By the definition: every word's segmentations summed, words multiplied, the posterior under equal priors."""
    words = regex.findall(r"(?:\p{L}\p{M}*)+", (text or "").lower())
    if not words or not langs:
        return "und", 0.0
    total = np.zeros(len(langs))
    for w in words:
        s = "▁" + w
        alpha = [np.zeros(len(langs))] + [np.full(len(langs), -np.inf) for _ in s]
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - lattices.widest), j):
                if s[i:j] in lattices.id:
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + np.log(p[lattices.id[s[i:j]]]))
            if s[j - 1] not in lattices.id:
                alpha[j] = np.logaddexp(alpha[j], alpha[j - 1] + sum(np.log(p[lattices.byte[b]]) for b in s[j - 1].encode()))
        total += alpha[-1]
    return langs[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())


def test_whole_documents_equal_brute_force(spark, lattices, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(odd.where("doc_id <> 8 and doc_id <> 7").select(F.col("doc_id") + 1_000_000, "text", "lang").toDF("doc_id", "text", "lang"))
    docs = docs.unionByName(spark.createDataFrame([(-1, "½ ² ① 12", "en"), (-2, "हिन्दी日本語" * 40, "en")], docs.schema))
    train = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~langid.held_out(F.col("doc_id")))
    langs, p = langid.learn(train, langid.pieces_of())
    got = {r.doc_id: r for r in langid.op3(docs).collect()}
    assert got[-1].lang_pred == "und" and got[-1].score == 0
    for r in docs.where("doc_id % 5 = 0 or doc_id < 0 or doc_id > 1000000").collect():
        lang, score = whole_document(r.text, lattices, langs, p)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-6)


def test_scores_stay_in_range(spark):
    rows = [(i, "the house and the garden of the king " * 3, "en") for i in range(40)] + [(100 + i, "das haus und der garten des kaisers " * 3, "de") for i in range(40)]
    rows += [(900, "the house of the king " + RUNS[0], "en"), (901, "das haus des kaisers " + RUNS[0], "de")]
    got = {r.doc_id: r for r in langid.op3(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
