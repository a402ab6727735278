import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def net(docs):
    return langid.train(docs)


def test_gradient_is_the_slope_of_the_loss():
    net = langid.ByteGRU.fresh(["a", "b", "c"], 1)
    r = np.random.default_rng(2)
    x, y = r.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 2, 1, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradient(x, y)
    for name in net.NAMES:
        flat, own = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(own))[:3]:
            was = flat[i]
            flat[i] = was + 1e-4
            up, _ = net.gradient(x, y)
            flat[i] = was - 1e-4
            down, _ = net.gradient(x, y)
            flat[i] = was
            assert own[i] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=1e-4), name


def test_held_out_accuracy(spark, docs, net):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = [r for r in langid.op9_language_id(spark, SF).collect()]
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    judged = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    assert np.mean(judged) >= 0.97


def plain(net, text):
    """Letter bytes' distributions of a whole text by one plain recurrence per direction."""
    x = np.frombuffer(text.lower().encode(), np.uint8)
    states = []
    for way in "fb":
        table, u, h, s, own = net.p["embed"] @ net.p["w" + way] + net.p["b" + way], net.p["u" + way], langid.HIDDEN, np.zeros(langid.HIDDEN), []
        for c in x if way == "f" else x[::-1]:
            a, b = table[c], s @ u
            z, r = (1 / (1 + np.exp(-(a[k * h : k * h + h] + b[k * h : k * h + h]))) for k in (0, 1))
            s = (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :]) + z * s
            own.append(s)
        states.append(own if way == "f" else own[::-1])
    logits = np.concatenate(states, axis=1) @ net.p["out"] + net.p["bias"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    letter = np.array([bytes([c]).isalpha() or c >= 128 for c in x])
    return (e / e.sum(axis=1, keepdims=True))[letter].sum(axis=0), letter.sum()


def test_reads_whole_texts_like_a_plain_recurrence(docs, net):
    texts = [t for t in (r.text for r in docs.limit(60).collect()) if t]
    got = net.sums([t.lower().encode() for t in texts])
    for t, row in zip(texts, got):
        want, n = plain(net, t)
        assert row[-1] == n and np.abs(row[:-1] - want).max() <= (0.002 if len(t.encode()) > langid.WINDOW else 1e-4) * max(n, 1)


def test_windows_label_every_byte_once(docs, net, monkeypatch):
    texts = [" ".join(r.text for r in docs.where(f"lang = '{lang}'").limit(12).collect()).lower().encode() for lang in ("en", "fr")]
    got = net.sums([*texts, b"", b"a"])
    assert [int(n) for n in got[:, -1]] == [sum(c >= 128 or bytes([c]).isalpha() for c in t) for t in texts] + [0, 1]
    monkeypatch.setattr(langid, "WINDOW", 10**9)
    whole = net.sums(texts)
    assert (np.abs(got[:2] - whole).max(axis=1) <= 0.02 * whole[:, -1]).all()


def test_threshold_rejects_what_no_language_fits(documents, net):
    assert 1 / len(net.langs) * 0.9 < net.least < 0.5
    rows = [(1, "the"), (2, "12 34"), (3, None)]
    assert [r.doc_id for r in langid.keep_identified(documents(rows), net).collect()] == [1]
    assert langid.keep_identified(documents(rows), net, least=1.1).count() == 0
    assert [r.doc_id for r in langid.keep_identified(documents(rows), None).collect()] == [1]


def test_no_letter_and_long_texts(documents, net):
    rows = [(1, None), (2, ""), (3, "123 ... 4 ² ½"), (4, "the " * 200_000), (5, "x" * 100_000), (None, "the"), (None, "the")]
    found = langid.identify(documents(rows, clash=True), net).collect()
    assert [(r.lang_pred, r.score) for r in found if r.own.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert len(found) == len(rows) and all(r.lang_pred in net.langs for r in found if r.own.doc_id in (4, 5, None))
    kept = langid.keep_identified(documents(rows, clash=True), net)
    assert kept.columns == documents(rows, clash=True).columns and kept.count() == 4


def test_nothing_to_learn_from(documents):
    assert langid.train(documents([])) is None
    assert langid.train(documents([(1, "word")])) is None
    assert [r.lang_pred for r in langid.identify(documents([(1, "word")]), None).collect()] == ["und"]


def test_wide_gradient_is_the_gradient():
    net = langid.ByteGRU.fresh(["a", "b", "c"], 1)
    r = np.random.default_rng(2)
    x, y = r.integers(0, 256, (9, 20)), r.integers(0, 3, 9)
    _, want = net.gradient(x, y)
    padded, weight = np.full((25, 9), langid.PAD), np.zeros((25, 9))
    padded[:20], weight[:20] = x.T, 2
    got = net.wide_gradient(padded, y, weight)
    assert all(np.abs(got[name] - want[name]).max() <= 1e-5 for name in net.NAMES)


def test_fit_reads_every_byte():
    net = langid.ByteGRU.fresh(["a", "b"], 1)
    rows = [("the ü ", "a"), ("", "b"), ("der " * 250_000, "b"), ("und", "b")]
    fitted, seen = net.fit_whole(iter(rows), {"a": 0.5, "b": 0.5})
    assert seen == sum(len(t.encode()) for t, _ in rows)
    assert all((fitted.p[name] != net.p[name]).any() for name in net.NAMES)


def test_threshold_is_of_all_documents_learnt_from(documents):
    """A document between three languages, learnt from but not in the sample."""
    odd = next(i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 4 != 2)
    words = {"en": "the and of to is ", "de": "der und die das ", "fr": "les des et la le "}
    rows = [(2000 * k + i, text * 4, lang, "s") for k, (lang, text) in enumerate(words.items()) for i in range(1500)]
    docs = documents([*rows, (odd, "".join(words.values()) * 6, "en", "s")])
    for net, same in ((langid.train(docs), True), (langid.train(docs, whole=False), False)):
        found = langid.identify(docs, net).where(~langid.held_out(F.col("own.doc_id")))
        lowest = found.agg(F.min("score")).first()[0]
        assert lowest == found.where(f"own.doc_id = {odd}").first().score
        assert (net.least == pytest.approx(0.99 * (0.9 / 3 + 0.1 * lowest), abs=1e-6)) == same
