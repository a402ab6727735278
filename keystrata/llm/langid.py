"""Language identification by a bidirectional gated recurrent network over bytes.

Both directions read all bytes of a text, and every byte gets a distribution over
the languages from the two states at it; a document's probabilities are the mean
over the bytes of its letters. Texts of up to ``WINDOW`` bytes and their context
run as one sequence. Longer ones are cut into windows of ``WINDOW`` bytes, each of
which the directions enter ``CONTEXT`` bytes early and whose context isn't pooled:
every byte of a text is labelled once, and no state depends on the text's length.
Windows of many texts run side by side, ordered by length.

The network is trained here, in numpy, by backpropagation through time (Adam on
the cross entropy of every byte's label). It starts from a bounded sample: the
``MAX_LANGS`` most frequent languages, ``SAMPLE_DOCS`` documents in all, the same
number per language and chosen by a hash of the id, and of each a stretch of
``SAMPLE_CHARS`` characters at a place drawn by hash; ``SAMPLE_CUTS`` sequences
per language are cut from these. ``train`` then goes once over every byte of every
document of these languages: each task fits the network to all texts of its
partition, in sequences of ``LENGTH`` bytes that weigh so that the languages count
alike, and the tasks' parameters are averaged by the bytes they saw (the figures
therefore depend a little on how the table is dealt to partitions). ``whole=False``
leaves that out. Documents that are held out, crc32(id) mod 4 = 2, and those
without a label are never learnt from.

``keep_identified`` rejects documents without a letter and those whose score lies
below the network's ``least``, a tenth of the way from chance (one language in so
many) to the lowest score of all documents learnt from, so what goes is text that
no language fits better than chance, and none of those documents. (With
``whole=False``: of every fifth document of the sample, kept out of the fit.) With
nothing to learn from, all with a letter stay.

Defined results
    null text or no letter: ``und`` with score 0. Nothing to learn from (empty
    table, no labels): ``und`` for all. A label ``und`` isn't learnt. null id: not
    held out. Repeated rows: each gives a row. Extra columns: not read; ``identify``
    returns them unharmed in the struct ``own``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

MAX_LANGS, SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_CUTS = 200, 1600, 1200, 2000
WINDOW, CONTEXT = 1024, 64
EMBED, HIDDEN = 8, 12
#: Lengths of the sequences that the network is trained on.
LENGTHS = (16, 40, 96)
EPOCHS, BATCH, STEP = 2, 192, 0.02
#: The pass over all texts: bytes and number of sequences of a step, steps between
#: which sequences are shuffled, and the step's size.
LENGTH, ROWS, HELD_STEPS, WHOLE_STEP = 96, 1024, 8, 0.001
#: Positions times languages that run side by side, and characters held at once.
CELLS, CHUNK_CHARS = 8_000_000, 2_000_000
#: Stands behind a sequence's end; its update gate is shut, so states stay.
PAD = 256
_LETTER = regex.compile(r"\p{L}")
#: Bytes of letters: ASCII letters and all bytes of longer UTF-8 sequences.
_LETTER_BYTE = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)] + [False], np.float32)


class ByteGRU:
    """Parameters of the two directions and of the label layer."""

    NAMES = ("embed", "wf", "uf", "bf", "wb", "ub", "bb", "out", "bias")

    def __init__(self, langs: list[str], p: dict[str, np.ndarray], least: float = 0.0):
        self.langs, self.p, self.least = langs, p, least
        self.key = hashlib.sha256(b"".join(p[n].tobytes() for n in self.NAMES)).hexdigest()

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 0) -> "ByteGRU":
        r, h, d = np.random.default_rng(seed), HIDDEN, EMBED
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls(langs, {"embed": make(256, d) * 8, "wf": make(d, 3 * h), "uf": make(h, 3 * h), "bf": np.zeros(3 * h, np.float32), "wb": make(d, 3 * h), "ub": make(h, 3 * h), "bb": np.zeros(3 * h, np.float32), "out": make(2 * h, len(langs)), "bias": np.zeros(len(langs), np.float32)})

    # --- reading ---------------------------------------------------------------

    def logits(self, x: np.ndarray, way: str) -> np.ndarray:
        """A direction's share of the logits at every position of sequences that
        stand in columns; (time, languages, sequences)."""
        h, (n, m) = HIDDEN, x.shape
        half = np.concatenate([np.full(2 * h, 0.5, np.float32), np.ones(h, np.float32)])  # a sigmoid is a tanh of half its argument
        table = np.zeros((257, 3 * h), np.float32)
        table[:256] = (self.p["embed"] @ self.p["w" + way] + self.p["b" + way]) * half
        table[PAD, :h] = 40
        table, u = np.ascontiguousarray(table.T), np.ascontiguousarray((self.p["u" + way] * half).T)
        out = np.ascontiguousarray(self.p["out"][:h].T if way == "f" else self.p["out"][h:].T)
        state, a, b = np.zeros((h, m), np.float32), np.empty((3 * h, m), np.float32), np.empty((3 * h, m), np.float32)
        gates, new, found = np.empty((2 * h, m), np.float32), np.empty((h, m), np.float32), np.empty((n, len(out), m), np.float32)
        for t in range(n) if way == "f" else range(n - 1, -1, -1):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.dot(u, state, out=b)
            np.add(a[: 2 * h], b[: 2 * h], out=gates)
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[h:], b[2 * h :], out=new)
            new += a[2 * h :]
            np.tanh(new, out=new)
            state -= new
            state *= gates[:h]
            state += new
            np.dot(out, state, out=found[t])
        return found

    def pooled(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums over the positions' distributions by weight; (sequences, languages)."""
        e = self.logits(x, "f")
        e += self.logits(x, "b")
        e += self.p["bias"][:, None]
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e *= (weight / e.sum(axis=1))[:, None, :]
        return e.sum(axis=0).T

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Per text the sum of its letter bytes' distributions, and their number."""
        out = np.zeros((len(texts), len(self.langs) + 1))
        cuts = [(i, a, max(a - CONTEXT, 0), min(e, len(t)), min(e + CONTEXT, len(t))) for i, t in enumerate(texts) for a, e in windows(len(t))]
        cuts.sort(key=lambda c: c[2] - c[4])
        at = 0
        while at < len(cuts):
            longest = max(1, cuts[at][4] - cuts[at][2])
            part = cuts[at : at + max(1, min(4096, CELLS // (max(8, len(self.langs)) * longest)))]
            at += len(part)
            x, core = np.full((len(part), longest), PAD, np.int64), np.zeros((len(part), longest), np.float32)
            for k, (i, a, low, e, high) in enumerate(part):
                x[k, : high - low] = np.frombuffer(texts[i], np.uint8, high - low, low)
                core[k, a - low : e - low] = 1
            core *= _LETTER_BYTE[x]
            got = np.concatenate([self.pooled(np.ascontiguousarray(x.T), np.ascontiguousarray(core.T)), core.sum(axis=1, keepdims=True)], axis=1)
            np.add.at(out, [c[0] for c in part], got)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        read = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        out = [("und", 0.0)] * len(texts)
        for i, row in zip(read, self.sums([texts[i].lower().encode("utf-8", "replace") for i in read])):
            best = int(row[:-1].argmax())
            out[i] = (self.langs[best], min(1.0, float(row[best] / row[-1])))
        return out

    # --- training --------------------------------------------------------------

    def run(self, x: np.ndarray, way: str, trace: list) -> np.ndarray:
        """States at every position of equally long byte rows; (time, rows, hidden)."""
        h, n = HIDDEN, x.shape[1]
        table, u = self.p["embed"] @ self.p["w" + way] + self.p["b" + way], self.p["u" + way]
        state, out = np.zeros((len(x), h), table.dtype), np.empty((n, len(x), h), table.dtype)
        for t in range(n) if way == "f" else range(n - 1, -1, -1):
            a, b = table[x[:, t]], state @ u
            gates = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * h] + b[:, : 2 * h]))
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            trace.append((t, state, z, r, new, b[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions' labels, and its gradient by
        backpropagation through time."""
        h, p, traces = HIDDEN, self.p, {"f": [], "b": []}
        states = np.concatenate([self.run(x, w, traces[w]) for w in "fb"], axis=2)
        logits = states @ p["out"] + p["bias"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        prob = e / e.sum(axis=2, keepdims=True)
        n, rows = x.shape[1], np.arange(len(x))
        loss = -np.log(prob[:, rows, y] + 1e-9).mean()
        prob[:, rows, y] -= 1
        prob /= n * len(x)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = states.reshape(-1, 2 * h).T @ prob.reshape(-1, prob.shape[2])
        g["bias"] = prob.sum(axis=(0, 1))
        back = prob @ p["out"].T
        for k, way in enumerate("fb"):
            da_all = np.empty((n, len(x), 3 * h), back.dtype)
            carry = np.zeros((len(x), h), back.dtype)
            for t, before, z, r, new, bn in reversed(traces[way]):
                d = back[t, :, k * h : (k + 1) * h] + carry
                dn = d * (1 - z) * (1 - new**2)
                dz = d * (before - new) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                da_all[t, :, : 2 * h], da_all[t, :, 2 * h :] = db[:, : 2 * h], dn
                g["u" + way] += before.T @ db
                carry = d * z + db @ p["u" + way].T
            into = np.zeros((256, 3 * h), back.dtype)
            np.add.at(into, x.T.reshape(-1), da_all.reshape(x.size, -1))
            g["b" + way] += into.sum(axis=0)
            g["w" + way] += p["embed"].T @ into
            g["embed"] += into @ p["w" + way].T
        return float(loss), g

    def wide_gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """As ``gradient``, for many sequences that stand in columns (time,
        sequences), with a weight for each position; ``PAD`` stands behind an end."""
        h, p, (n, m) = HIDDEN, self.p, x.shape
        states, traces = np.empty((n, 2 * h, m), np.float32), []
        for k, way in enumerate("fb"):
            table = np.zeros((3 * h, 257), np.float32)
            table[:, :256] = (p["embed"] @ p["w" + way] + p["b" + way]).T
            table[:h, PAD] = 80
            u, state = np.ascontiguousarray(p["u" + way].T), np.zeros((h, m), np.float32)
            gates, new, bn = np.empty((n, 2 * h, m), np.float32), np.empty((n, h, m), np.float32), np.empty((n, h, m), np.float32)
            for t in range(n) if way == "f" else range(n - 1, -1, -1):
                a, b, g = np.take(table, x[t], axis=1, mode="clip"), u @ state, gates[t]
                np.add(a[: 2 * h], b[: 2 * h], out=g)
                g *= 0.5
                np.tanh(g, out=g)
                g *= 0.5
                g += 0.5
                bn[t] = b[2 * h :]
                np.multiply(g[h:], bn[t], out=new[t])
                new[t] += a[2 * h :]
                np.tanh(new[t], out=new[t])
                after = states[t, k * h : (k + 1) * h]
                np.subtract(state, new[t], out=after)
                after *= g[:h]
                after += new[t]
                state = after
            traces.append((gates, new, bn))
        prob = np.matmul(p["out"].T, states)
        prob += p["bias"][:, None]
        prob -= prob.max(axis=1, keepdims=True)
        np.exp(prob, out=prob)
        prob /= prob.sum(axis=1, keepdims=True)
        prob[:, y, np.arange(m)] -= 1
        prob *= (weight / weight.sum())[:, None, :].astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = np.matmul(states, prob.transpose(0, 2, 1)).sum(axis=0)
        g["bias"] = prob.sum(axis=(0, 2))
        back = np.matmul(p["out"], prob)
        x = np.minimum(x, 255)  # what stands on PAD has no gradient
        embed, into = np.ascontiguousarray(p["embed"].T), np.zeros((EMBED, n, m), np.float32)
        for k, way in enumerate("fb"):
            (gates, new, bn), u, w = traces[k], p["u" + way], p["w" + way]
            carry, da, db = np.zeros((h, m), np.float32), np.empty((3 * h, m), np.float32), np.empty((3 * h, m), np.float32)
            for t in range(n - 1, -1, -1) if way == "f" else range(n):
                first = t == (0 if way == "f" else n - 1)
                before = np.zeros((h, m), np.float32) if first else states[t + (-1 if way == "f" else 1), k * h : (k + 1) * h]
                z, r, at = gates[t, :h], gates[t, h:], new[t]
                d = back[t, k * h : (k + 1) * h] + carry
                dz = d * z
                shut = d - dz  # d * (1 - z)
                np.multiply(shut, z, out=db[:h])
                db[:h] *= before - at
                dn = da[2 * h :]
                np.multiply(shut, 1 - at * at, out=dn)
                np.multiply(dn, r, out=db[2 * h :])
                np.multiply(db[2 * h :], (1 - r) * bn[t], out=db[h : 2 * h])
                da[: 2 * h] = db[: 2 * h]
                g["u" + way] += before @ db.T
                g["b" + way] += da.sum(axis=1)
                g["w" + way] += np.take(embed, x[t], axis=1) @ da.T
                into[:, t] += w @ da
                carry = u @ db
                carry += dz
        for j in range(EMBED):
            g["embed"][:, j] = np.bincount(x.reshape(-1), into[j].reshape(-1), 256)
        return g

    def fit_whole(self, rows: Iterator[tuple[str, str]], weights: dict[str, float]) -> tuple["ByteGRU", int]:
        """Fits a copy to every byte of all (text, language) pairs, and tells how
        many bytes these were."""
        net, seen, r = ByteGRU(self.langs, {k: v.copy() for k, v in self.p.items()}), 0, np.random.default_rng(0)
        adam, number = Adam(net.p), {lang: i for i, lang in enumerate(self.langs)}
        held, labels = [], []

        def run() -> None:
            x, y = np.concatenate(held), np.array(labels)
            share = np.array([weights[lang] for lang in self.langs], np.float32)[y]
            order = r.permutation(len(x))
            for a in range(0, len(x), ROWS):
                part = order[a : a + ROWS]
                cut = np.ascontiguousarray(x[part].T)
                adam.step(net.p, net.wide_gradient(cut, y[part], (cut != PAD) * share[part]), WHOLE_STEP * min(1.0, len(part) / ROWS))

        for text, lang in rows:
            raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
            seen += len(raw)
            for a in range(0, len(raw), LENGTH * ROWS * HELD_STEPS):
                part = raw[a : a + LENGTH * ROWS * HELD_STEPS]
                x = np.full(-(-len(part) // LENGTH) * LENGTH, PAD, np.int16)
                x[: len(part)] = part
                held.append(x.reshape(-1, LENGTH))
                labels += [number[lang]] * len(held[-1])
                if len(labels) >= ROWS * HELD_STEPS:
                    run()
                    held, labels = [], []
        if labels:
            run()
        return net, seen


class Adam:
    """Adam on gradients whose norm is at most 1."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v, self.k = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.k += 1
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        for name in p:
            self.m[name] = 0.9 * self.m[name] + 0.1 * g[name] * scale
            self.v[name] = 0.99 * self.v[name] + 0.01 * (g[name] * scale) ** 2
            p[name] -= (rate * (self.m[name] / (1 - 0.9**self.k)) / (np.sqrt(self.v[name] / (1 - 0.99**self.k)) + 1e-8)).astype(np.float32)


def windows(n: int) -> list[tuple[int, int]]:
    """The runs of bytes that a text of n bytes is labelled in."""
    if n <= WINDOW + 2 * CONTEXT:
        return [(0, n)]
    parts = -(-n // WINDOW)
    edges = [n * k // parts for k in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def train_network(texts: list[tuple[str, str]], seed: int = 0) -> ByteGRU:
    """Fits to sequences cut from (text, language) pairs at random places."""
    langs = sorted({lang for _, lang in texts})
    net, r = ByteGRU.fresh(langs, seed), np.random.default_rng(seed)
    raw = {lang: [t.lower().encode("utf-8", "replace") for t, own in texts if own == lang] for lang in langs}
    lens = {lang: np.array([len(t) for t in raw[lang]]) for lang in langs}

    def cut(lang: str, n: int) -> bytes:
        t = raw[lang][r.choice(len(raw[lang]), p=lens[lang] / lens[lang].sum())]
        a = r.integers(0, max(1, len(t) - n + 1))
        return (t[a : a + n] + b" " * n)[:n]

    batches = []
    each = max(1, BATCH // len(langs))
    for k in range(-(-SAMPLE_CUTS // each)):
        n = LENGTHS[k % len(LENGTHS)]
        rows = [(cut(lang, n), i) for i, lang in enumerate(langs) for _ in range(each)]
        x, y = np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(-1, n), np.array([i for _, i in rows])
        order = r.permutation(len(rows))
        batches += [(x[order[j : j + BATCH]], y[order[j : j + BATCH]]) for j in range(0, len(rows), BATCH)]
    adam, steps = Adam(net.p), EPOCHS * len(batches)
    for _ in range(EPOCHS):
        for b in r.permutation(len(batches)):
            _, g = net.gradient(*batches[b])
            adam.step(net.p, g, STEP * (1 - 0.95 * (adam.k + 1) / steps))
    return ByteGRU(langs, net.p)


def network_of(langs: list[str], p: dict[str, np.ndarray]) -> ByteGRU:
    """One per Python worker and network."""
    net = ByteGRU(langs, p)
    return scratch.worker_memo(("langid", net.key), lambda: net)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 0, whole: bool = True) -> ByteGRU | None:
    """Fits to the bounded sample and then to all documents; None if there is nothing
    to learn from. Four scans: the labels' counts, the sample, the fit and the scores
    of all documents learnt from; two without ``whole``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & (F.col("lang") != "und") & F.col("id").isNotNull() & F.col("text").isNotNull())
    langs = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("text")).alias("size")).orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not langs:
        return None
    each = max(8, SAMPLE_DOCS // max(4, len(langs)))
    # Hashes below a share of their range that holds enough of the language: what
    # comes to the driver is bounded, and nothing is ranked by a shuffle.
    unit = lambda *salt: F.shiftrightunsigned(F.xxhash64("id", *map(F.lit, salt)), 11) / F.lit(float(2**53))
    share = F.create_map(*(F.lit(x) for r in langs for x in (r.lang, (1.3 * each + 30) / r["count"])))
    start = F.floor(unit("stretch") * F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    drawn = usable.select("id", "lang", unit().alias("place"), "text").where(F.col("place") < F.element_at(share, F.col("lang")))
    drawn = drawn.select("lang", "place", F.col("id").cast("string").alias("id"), F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    fit, rest = [], []
    for r in langs:
        own = sorted({(x.place, x.id, x.text) for x in drawn if x.lang == r.lang and _LETTER.search(x.text)})[:each]
        rest += [(t, r.lang) for _, _, t in own[4::5]]
        fit += [(t, r.lang) for k, (_, _, t) in enumerate(own) if k % 5 != 4]
    if not fit:
        return None
    net = train_network(fit, seed)
    chance = 1 / len(net.langs)
    if whole:
        learnt = usable.where(F.col("lang").isin(net.langs)).select("text", "lang")
        net = _fitted(learnt, net, {r.lang: 1 / max(1, r["size"]) for r in langs})
        lowest = identify(learnt, net).where(F.col("lang_pred") != "und").agg(F.min("score")).first()[0]
        return ByteGRU(net.langs, net.p, 0.99 * (0.9 * chance + 0.1 * (chance if lowest is None else lowest)))
    lowest = min((s for _, s in net.predict([t for t, _ in rest])), default=chance)
    return ByteGRU(net.langs, net.p, 0.99 * (0.9 * chance + 0.1 * lowest))


def _fitted(rows: DataFrame, net: ByteGRU, weights: dict[str, float]) -> ByteGRU:
    """The mean of the networks that the tasks fit to all their rows (text, lang)."""
    scratch.ship(rows.sparkSession)
    langs, p = net.langs, net.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((t.as_py(), lang.as_py()) for batch in batches for t, lang in zip(*batch.columns))
        own, seen = network_of(langs, p).fit_whole(pairs, weights)  # frees what another stage kept
        scratch.give_back()
        if seen:
            flat = np.concatenate([own.p[n].reshape(-1) for n in own.NAMES]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen, np.int64))], ["at", "value", "seen"])

    sums = rows.mapInArrow(run, "at long, value double, seen long").groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value"))
    flat = np.array([r.value for r in sums.orderBy("at").collect()], np.float32)
    if not len(flat):
        return net
    ends = np.cumsum([p[n].size for n in net.NAMES])
    return ByteGRU(langs, {n: part.reshape(p[n].shape) for n, part in zip(net.NAMES, np.split(flat, ends[:-1]))})


def identify(docs: DataFrame, net: ByteGRU | None, text_col: str = "text") -> DataFrame:
    """own (a struct of all the row's columns), lang_pred and score."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    rows = docs.select(own, F.col(text_col).cast("string").alias("text"))
    if net is None:
        return rows.select("own", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    scratch.ship(docs.sparkSession)
    langs, p = net.langs, net.p

    # Only the texts go to the Python workers, and only labels and scores come back:
    # an executor holds the rows' other columns once.
    @F.arrow_udf("lang_pred string, score double")
    def labels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = network_of(langs, p)
        for batch in batches:
            size = pa.compute.utf8_length(batch).fill_null(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_CHARS)) + 1), len(batch)]
            found = []
            for a, b in zip(cuts, cuts[1:]):
                found += net.predict(batch.slice(a, b - a).to_pylist())
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang_pred", "score"])
        scratch.give_back()

    # Else the optimiser may run it once per column and filter that reads it.
    return rows.select("own", labels.asNondeterministic()("text").alias("found")).select("own", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, net: ByteGRU | None, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The documents that have a language, with all their columns; ``least`` stands
    in for the network's own threshold."""
    if net is None:
        return docs.where(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    found = identify(docs, net, text_col)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= (net.least if least is None else least))).select("own.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs, whole=False))
    return found.select(F.col("own.doc_id").alias("doc_id"), held_out(F.col("own.doc_id")).alias("held_out"), "lang_pred", "score")
