"""Personal data: generators propose spans, boosted trees select among them.

Base spans (email, ip, card, phone) are found by fixed patterns and always stay.
Further, high-recall generators propose spelled-out emails, phone numbers that the
base pattern runs past or that lack a country code, identity numbers, IBANs and
secrets (tokens, keys, passwords). They propose at every start and, for phone
numbers, with every number of digit groups, so proposals overlap as they may.
Gradient-boosted trees score each one by its format and context; a Platt fit turns
scores into probabilities and a threshold per kind, the least that reaches
``PRECISION`` on texts held out from the trees, selects. A selected span that meets
a base span or a better one is dropped. Trees are trained here, on generated texts,
and are compiled to CASE expressions: the scan runs in the JVM alone.

The base patterns are the contract's with two changes that alter no match: a run of
characters is entered at its start or behind the last match (so a long run costs
linear time), and loops are possessive where nothing follows (so a long match
needs no stack). Places come from running sums over the matches in two levels, and
overlaps from binary searches, so n matches in a text cost about n**1.5 cheap steps.

Defined results
    null or empty text: no spans. Offsets are code points, ends exclusive.
    Repeated rows: each gives a row. Null ids stay null. Empty table: empty
    result. Extra columns are not read. Runs of over 512 characters are no secret.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind's pattern; all but those of
#: ``UNNUMBERED`` need a digit as well.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "email_spelled": r"(?i)[(\[]at[)\]]", "phone_more": r"\+[0-9]", "phone_local": r"[0-9]{2}\)?[ ./-]{1,2}[0-9]{2}", "id_number": r"[0-9]{3}-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"[A-Za-z0-9+/_-]{16}"}
UNNUMBERED = ("email", "email_spelled")
#: What a proposal begins with, asked before anything else for speed.
FIRST = {"email_spelled": r"[A-Za-z0-9._%+-]", "phone_more": r"\+", "phone_local": r"[(0-9]", "id_number": "[0-9]", "iban": "[A-Z]", "secret": r"[A-Za-z0-9+/_-]"}
#: Generators: the kind that they propose, and what stands at a proposal's start.
GENERATORS = [
    ("email_spelled", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{2,24}){1,4}"),
    *(("phone_more", rf"(?<![A-Za-z0-9+])\+[0-9]{{1,3}}[ .-]{{0,2}}(?:\([0-9]{{1,4}}\)[ .-]{{0,2}})?[0-9]{{2,5}}(?:[ .-]{{1,2}}[0-9]{{2,5}}){{{k}}}(?![0-9])") for k in (1, 2, 3)),
    *(("phone_local", rf"(?<![A-Za-z0-9+.,-])(?:\([0-9]{{2,5}}\)|[0-9]{{2,5}})(?:[ ./-]{{1,2}}[0-9]{{2,5}}){{{k}}}(?![A-Za-z0-9])") for k in (1, 2, 3, 4)),
    ("id_number", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,127}[0-9])[A-Za-z0-9+/_-]{16,512}+={0,2}(?![A-Za-z0-9+/_=-])"),
]
MORE = tuple(dict.fromkeys(k for k, _ in GENERATORS))
KINDS = [*BASE, *MORE]
#: No proposal is longer.
LONGEST = 600
CONTEXT = 40
ROUNDS, DEPTH, RATE, BINS = 40, 4, 0.25, 24
PRECISION = 0.97


def quoted(text: str) -> str:
    """A raw SQL literal of a pattern."""
    return "r'" + text.replace("'", r"\x27") + "'"


def let(value: str, name: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Running sums of an array<int> by name. The array is cut into about sqrt(n) runs,
#: since Spark copies an array that grows with every entry added.
_GROWN = "concat(acc, array(coalesce(try_element_at(acc, -1), 0) + {}))"
_WIDTH = "cast(ceil(sqrt(size({0}))) as int)"
_RUNS = "transform(sequence(0, cast((size({0}) - 1) div " + _WIDTH + " as int)), k -> aggregate(slice({0}, k * " + _WIDTH + " + 1, " + _WIDTH + "), cast(array() as array<int>), (acc, x) -> " + _GROWN.format("x") + "))"
_OFFSETS = "slice(aggregate(runs, array(0), (acc, x) -> " + _GROWN.format("element_at(x, -1)") + "), 1, size(runs))"


def running(steps: str) -> str:
    """SQL: the running sums of an expression's array<int>."""
    joined = let(_RUNS.format("steps"), "runs", f"flatten(zip_with(runs, {_OFFSETS}, (x, o) -> transform(x, y -> y + o)))")
    return let(steps, "steps", f"if(size(steps) > 0, {joined}, cast(array() as array<int>))")


def found(text: str, pattern: str) -> Column:
    """array<struct<start, end, m>> of all matches in the column ``text``: the gaps
    between matches give their places."""
    p = quoted(pattern)
    ends = running(f"zip_with(slice(split({text}, {p}, -1), 1, size(ms)), ms, (g, m) -> length(g) + length(m))")
    placed = f"zip_with(ms, {ends}, (m, e) -> named_struct('start', e - length(m), 'end', e, 'm', m))"
    return F.expr(f"if({text} rlike {p}, {let(f'regexp_extract_all({text}, {p}, 0)', 'ms', placed)}, cast(array() as array<struct<start:int,end:int,m:string>>))")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    terms = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(text: str, kind: str) -> Column:
    spans = F.filter(found(text, BASE[kind]), lambda s: _holds(kind, s["m"]))
    near = F.col(text).rlike(HINT[kind])
    return F.when(near if kind in UNNUMBERED else F.col("numbered") & near, spans).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)"))


# --- features of proposals ---------------------------------------------------

CUES = {
    "phone": r"(?i)\b(?:phone|tel|telefon|t[eé]l[eé]fono?|call|mobile|mobil|cell|fax|handy|ring|whatsapp|dial|reach)\b",
    "mail": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt|reach)\b",
    "id": r"(?i)\b(?:ssn|social|security|identity|id|passport|insured|taxpayer|dni|patient)\b",
    "bank": r"(?i)\b(?:iban|account|bank|konto|transfer|compte|cuenta|pay(?:ment)?)\b",
    "secret": r"(?i)(?:token|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|passw(?:or)?d|pwd|auth|bearer|credential)",
    "digest": r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|hash|etag|uuid|build|revision)",
    "not": r"(?i)(?:version|isbn|order|invoice|ref|part|serial|model|page|date|score|total|price|sku|[#$€£v=/]\s*$)",
}


def features(n: int) -> list[str]:
    """SQL: of a proposal ``m`` of generator ``n``, with ``before`` and ``after``,
    the text on both sides."""
    kind, digits = GENERATORS[n][0], "regexp_replace(m, '[^0-9]', '')"
    like = lambda what, pattern: f"cast({what} rlike {quoted(pattern)} as int)"
    check = {
        "iban": "cast(aggregate(split(concat(substring(replace(m, ' ', ''), 5), left(replace(m, ' ', ''), 4)), ''), 0, (a, c) -> if(c rlike '[0-9]', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1 as int)",
        "id_number": "1 - " + like("m", r"\A(?:000|666|9..)|-00-|-0000\z"),
        "phone_local": f"if(length({digits}) between 9 and 12, {like('m', r'\A[(0]|\A[2-9][0-9]{2}[) .-]')}, 0)",
        "phone_more": f"cast(length({digits}) between 10 and 15 as int)",
        "secret": "cast(m rlike '[A-Za-z]' and size(array_distinct(split(m, ''))) >= 9 as int)",
        "email_spelled": like("m", r"(?i)(?:com|org|net|edu|io|de|fr|es|info)\z"),
    }
    return [
        str(n),
        "length(m)",
        f"length({digits})",
        "length(regexp_replace(m, '[A-Za-z0-9]', ''))",
        f"size(array_distinct(split({digits}, '')))",
        check[kind],
        like("before", r"[A-Za-z0-9]\z"),
        like("after", r"\A[A-Za-z0-9%$€:/=-]"),
        like("m", r"\A(?:19|20)[0-9]{2}[-/. ]|[-/. ](?:19|20)[0-9]{2}\z"),
        *(like("before", cue) for cue in CUES.values()),
        like("before", r"[0-9][ ,./-]*\z") + " + " + like("after", r"\A[ ,./-]*[0-9]"),
        like("after", r"\A\.[0-9]") + " + " + like("m", r"[0-9]\.[0-9]+\."),
        like("m", r"\A[0-9a-f]+\z") + " + " + like("m", "[a-z]") + " + " + like("m", "[A-Z]"),
        like("before", r"""[=:]\s*["']?\z"""),
        like("m", r"[ /.-]{2}|[/][0-9]"),
    ]


def proposals(text: str, kind: str) -> str:
    """SQL: array<struct<start, end, kind, f array<double>>> of a kind's generators
    in the column ``text``. A match has no width, so every start has its own: pieces
    between starts give the places and the text before, a second group the text
    behind."""
    none = "cast(array() as array<struct<start:int,end:int,kind:int,f:array<double>>>)"
    led = f"concat('\n', {text})"  # else split() passes over a match at 0

    def of(n: int) -> str:
        # The lookbehind stays in front, the rest is looked for ahead.
        plain = GENERATORS[n][1].replace("(?i)", "")
        guard, _, rest = plain.partition(")")
        p = quoted(f"{'(?is)' if plain != GENERATORS[n][1] else '(?s)'}(?={FIRST[kind]}){guard})(?=({rest})(.{{0,12}}))")
        starts = running("transform(slice(pieces, 1, size(ms)), x -> length(x))")
        before = f"transform(sequence(0, size(ms) - 1), i -> right(concat(if(i > 0, right(pieces[i - 1], {CONTEXT}), ''), right(pieces[i], {CONTEXT})), {CONTEXT}))"
        sides = f"zip_with({before}, regexp_extract_all({led}, {p}, 2), (x, y) -> named_struct('before', x, 'after', y))"
        spans = f"zip_with(ms, {starts}, (x, y) -> named_struct('m', x, 'start', y - 1))"
        got = ", ".join(f"cast({f} as double)" for f in features(n))
        inner = let("y.after", "after", let("y.before", "before", let("x.m", "m", f"array({got})")))
        made = f"zip_with({spans}, {sides}, (x, y) -> named_struct('start', x.start, 'end', x.start + length(x.m), 'kind', {KINDS.index(kind)}, 'f', {inner}))"
        return f"if({led} rlike {p}, {let(f'regexp_extract_all({led}, {p}, 1)', 'ms', let(f'split({led}, {p}, -1)', 'pieces', made))}, {none})"

    made = f"concat({', '.join(of(n) for n, g in enumerate(GENERATORS) if g[0] == kind)})"
    return f"if({text} rlike {quoted(HINT[kind])}, {made}, {none})"


def proposed(text: str) -> Column:
    """All kinds' proposals; the column ``numbered`` tells whether there is a digit."""
    of = lambda numbered: f"concat({', '.join(proposals(text, k) for k in MORE if numbered or k in UNNUMBERED)})"
    return F.expr(f"if(numbered, {of(True)}, {of(False)})")


# --- training ----------------------------------------------------------------


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def training_texts(n: int = 2400, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated texts with the places of personal data in them."""
    r = random.Random(seed)
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuw") for _ in range(r.randint(2, 9)))

    def iban() -> str:
        country, body = r.choice([("DE", dig(18)), ("FR", dig(23)), ("ES", dig(20)), ("GB", "".join(r.choice("ABCDEFGHKLMNPRSTW") for _ in range(4)) + dig(14))])
        number = int("".join(str(int(c, 36)) for c in body + country + "00"))
        raw = f"{country}{98 - number % 97:02d}{body}"
        return " ".join(raw[i : i + 4] for i in range(0, len(raw), 4)) if r.random() < 0.5 else raw

    def local() -> str:
        return r.choice([f"({r.randint(201, 989)}) {r.randint(200, 999)}-{dig(4)}", f"{r.randint(201, 989)}-{r.randint(200, 999)}-{dig(4)}", f"0{dig(2)} {dig(3)} {dig(4)}", f"0{dig(3)}/{dig(3)} {dig(4)}", f"0{r.randint(1, 9)} {dig(2)} {dig(2)} {dig(2)} {dig(2)}", f"{r.randint(201, 989)}.{r.randint(200, 999)}.{dig(4)}"])

    def spelled() -> str:
        at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", ".")])
        return f"{word()}{r.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"

    def plus() -> str:
        return r.choice([f"+1 ({r.randint(201, 989)}) {r.randint(200, 999)}-{dig(4)}", f"+{r.randint(30, 59)} {dig(3)} {dig(4)} {dig(3)}", f"+44 {dig(4)} {dig(6)[:5]}{dig(1)}"[:15], f"+49 {dig(3)} {dig(4)}-{dig(3)}", f"+33 {dig(3)} {dig(3)} {dig(3)}", f"+34.{dig(3)}.{dig(3)}.{dig(3)}", f"+1-{r.randint(201, 989)}-{r.randint(200, 999)}-{dig(4)}"])

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def chars(alphabet: str, n: int) -> str:
        made = "".join(r.choice(alphabet) for _ in range(n))
        return made if any(c.isdigit() for c in made) else made[:-1] + "7"

    def secret() -> str:
        return r.choice([chars("0123456789abcdef", r.choice([32, 40, 40, 48, 64])), "sk_live_" + chars(ALNUM, 24), "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + chars(ALNUM, 36), chars(ALNUM + "+/", r.choice([43, 64])) + "=", chars(ALNUM + "_-", r.randint(18, 60))])

    def ssn() -> str:
        return f"{r.choice([r.randint(1, 665), r.randint(667, 899)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"

    cue = {
        "local": ["phone", "tel:", "call me at", "mobile", "fax", "Tel.", "téléphone", "Telefon", "teléfono", "reach us on"],
        "iban": ["IBAN", "account", "bank account", "Konto", "pay to", "transfer to", "cuenta"],
        "spelled": ["mail", "contact", "e-mail:", "write to", "Kontakt", "reach me:"],
        "ssn": ["SSN", "social security number", "SSN:", "identity no", "patient id"],
        "plus": ["phone", "call", "tel:", "Telefon", "reach us on", "fax"],
        "secret": ["token =", "secret:", "api_key =", "password:", "Authorization: Bearer", "access_key=", "auth token", "API key", "client_secret ="],
    }
    make = {"local": local, "iban": iban, "spelled": spelled, "ssn": ssn, "plus": plus, "secret": secret}

    def negative() -> str:
        y = r.randint(1950, 2030)
        return r.choice([
            f"{y}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{y}", f"{r.randint(1, 12):02d}/{r.randint(1, 28):02d}/{y}",
            f"{y}-{y + r.randint(1, 30)}", f"version {r.randint(1, 20)}.{dig(2)}.{dig(3)}", f"order {dig(3)}-{dig(2)}-{dig(4)}", f"part {dig(3)}-{dig(3)}-{dig(4)}", f"ISBN 978-{dig(1)}-{dig(4)}-{dig(4)}-{dig(1)}",
            f"{dig(2)} {dig(3)} {dig(3)}", f"{r.randint(10, 99)} {dig(2)} {dig(2)} {dig(2)}", f"total {r.randint(1, 999)} {dig(3)} {dig(3)}", f"ref {dig(4)}-{dig(4)}-{dig(4)}", f"9{dig(2)}-{dig(2)}-{dig(4)}", f"000-{dig(2)}-{dig(4)}",
            f"{r.choice('ABCDEFGH')}{r.choice('KLMNP')}{dig(2)} {dig(4)} {dig(4)} {dig(4)}", f"serial {r.choice('ABCD')}{r.choice('XYZ')}{dig(12)}", f"pages {dig(3)}-{dig(3)}", f"{word()} (at) {word()}", f"meet [at] {word()} . {word()}",
            ip(), ip(), f"{ip()} {ip()}", f"host {ip()} port {dig(4)}", dig(16), f"{dig(4)} {dig(4)} {dig(4)} {dig(4)}", f"{dig(3)}-{dig(3)}-{dig(3)}", f"+{dig(1)}.{dig(2)} %",
            f"{r.choice(['commit', 'sha1', 'md5', 'checksum:', 'etag', 'uuid', 'build'])} {chars('0123456789abcdef', r.choice([32, 40, 64]))}", f"https://{word()}.example.org/{word()}/{word()}-{word()}-{dig(5)}", f"{word()}_{word()}_{word()}_{dig(4)}", f"uuid {chars('0123456789abcdef', 8)}-{chars('0123456789abcdef', 4)}-4{dig(3)}-{chars('0123456789abcdef', 12)}", f"/usr/{word()}/{word()}{dig(2)}/{word()}",
            f"{r.randint(1, 12)}:{dig(2)} {y}-{dig(2)}-{dig(2)} {dig(2)}:{dig(2)}", f"{dig(5)} {dig(5)} {dig(5)}", f"score {dig(2)}-{dig(2)} {dig(2)}-{dig(2)}", f"price ${dig(3)}.{dig(2)}",
        ])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(1, 12))) + r.choice([" ", ". ", ", ", ": "])
            if r.random() < 0.5:
                text += negative()
            else:
                kind = r.choice(list(make))
                if r.random() < 0.75 or kind in ("ssn", "secret") and r.random() < 0.9:
                    text += r.choice(cue[kind]) + r.choice([" ", ": ", " is "] if kind != "secret" else [" ", ' "', "'", ""])
                span = make[kind]()
                spans.append((len(text), len(text) + len(span)))
                text += span + (" " + r.choice([ip(), dig(3), ip()]) if kind in ("plus", "local") and r.random() < 0.2 else '"' if kind == "secret" and r.random() < 0.4 else "")
            text += r.choice([" ", ". ", ", ", "\n"])
        out.append((text, spans))
    return out


def _fit_tree(codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree by second-order gain: (feature, threshold, left, right)
    or a leaf's value. ``codes`` are the features' bins."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 12:
        for f, cuts in enumerate(edges):
            own = codes[rows, f]
            gl = np.cumsum(np.bincount(own, grad[rows], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(own, hess[rows], len(cuts) + 1))[:-1]
            gain = np.where(np.minimum(hl, h - hl) > 1e-3, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), 0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (f, int(gain.argmax())))
    if best[1] is None:
        return float(-RATE * g / (h + 1.0))
    f, k = best[1]
    low = codes[rows, f] <= k
    return f, float(edges[f][k]), _fit_tree(codes, edges, grad, hess, rows[low], depth - 1), _fit_tree(codes, edges, grad, hess, rows[~low], depth - 1)


def _tree_value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _tree_value(low, x), _tree_value(high, x))


def fit_boosting(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Logistic loss; the start score and the trees."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS), method="lower"))[:-1] for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    score, trees = np.full(len(x), start), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = _fit_tree(codes, edges, p - y, p * (1 - p), np.arange(len(x)), DEPTH)
        trees.append(tree)
        score += _tree_value(tree, x)
    return start, trees


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w, e = p * (1 - p) + 1e-9, y - p
        hess = np.array([[(w * score**2).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(e * score).sum() - 1e-3 * (a - 1), e.sum()])
        a, b = a + da, b + db
    return float(a), float(b)


class Model:
    """Trees, calibration and the threshold of each kind."""

    def __init__(self, start: float, trees: list, platt: tuple[float, float], thresholds: dict[str, float]):
        self.start, self.trees, self.platt, self.thresholds = start, trees, platt, thresholds

    def score(self, spans: str) -> Column:
        """start, end, kind and calibrated probability ``p`` of proposals. The trees
        are nested CASE expressions, given as SQL, which Spark parses at once."""

        def case(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            return f"if(s.f[{tree[0]}] <= {tree[1]!r}D, {case(tree[2])}, {case(tree[3])})"

        total = " + ".join([f"{self.start!r}D", *map(case, self.trees)])
        p = f"1D / (1D + exp(-(({total}) * {self.platt[0]!r}D + {self.platt[1]!r}D)))"
        return F.expr(f"transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'p', {p}))")


def labelled(spark: SparkSession, texts: list[tuple[str, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and text numbers of all proposals in the texts."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, text string").withColumn("numbered", F.col("text").rlike("[0-9]"))
    x, y, at = [], [], []
    for i, made in df.select("i", proposed("text").alias("made")).collect():
        for r in made:
            x.append(r.f)
            y.append(any(min(b, r.end) - max(a, r.start) >= 0.8 * max(b - a, r.end - r.start) for a, b in texts[i][1]))
            at.append(i)
    return np.array(x), np.array(y, float), np.array(at)


@lru_cache(maxsize=2)
def train(spark: SparkSession, n: int = 2400, seed: int = 7) -> Model:
    """Fits on two thirds of ``n`` generated texts, calibrates on the rest."""
    x, y, at = labelled(spark, training_texts(n, seed))
    fit = at % 3 != 0
    start, trees = fit_boosting(x[fit], y[fit])
    score = start + sum(_tree_value(t, x[~fit]) for t in trees)
    a, b = _platt(score, y[~fit])
    p, truth, kind = 1 / (1 + np.exp(-(a * score + b))), y[~fit], np.array([GENERATORS[int(g)][0] for g in x[~fit][:, 0]])
    thresholds = {}
    for k in MORE:
        own = kind == k
        cuts = [t for t in np.arange(0.02, 1.0, 0.01) if (own & (p >= t)).any() and truth[own & (p >= t)].mean() >= PRECISION]
        thresholds[k] = float(cuts[0]) if cuts else 1.01
    return Model(start, trees, (a, b), thresholds)


# --- the operator ------------------------------------------------------------


def starting_before(spans: str, bound: str) -> str:
    """SQL: how many spans, in order of their starts, start before a place."""
    steps = ", ".join(str(1 << i) for i in range(24, -1, -1))
    return f"aggregate(array({steps}), 0, (low, step) -> if(low + step <= size({spans}) and coalesce({spans}[low + step - 1].start < {bound}, false), low + step, low))"


def select(base: list[str], scored: str) -> Column:
    """Of scored spans those that meet no base span and no better scored one:
    better is likelier, then longer, then earlier, then of the kind listed first."""
    ranked = f"array_sort(transform({scored}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'p', s.p, 'rank', named_struct('p', s.p, 'n', s.end - s.start, 'at', -s.start, 'k', -s.kind))))"
    # Spans of a base kind don't meet each other: the last one before the end decides.
    met = " or ".join(let(starting_before(f"v.b{i}", "s.end"), "n", f"(n > 0 and coalesce(v.b{i}[n - 1].end > s.start, false))") for i in range(len(base)))
    around = let(starting_before("v.scored", f"(s.start - {LONGEST})"), "n", f"slice(v.scored, n + 1, {starting_before('v.scored', 's.end')} - n)")
    beaten = f"exists({around}, o -> o.end > s.start and o.rank > s.rank)"
    held = f"named_struct('scored', {ranked}, {', '.join(f"'b{i}', {b}" for i, b in enumerate(base))})"
    stay = f"filter(v.scored, s -> not ({met} or {beaten}))"
    return F.expr(let(held, "v", f"transform({stay}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'p', s.p))"))


def find_pii(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one array of spans per base kind, ``more`` (selected spans of the
    other kinds, with their probability) and ``text``."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("numbered", F.col("text").rlike("[0-9]"))
    df = df.select("doc_id", "text", *(base_spans("text", k).alias(f"s_{k}") for k in BASE), proposed("text").alias("proposed"))

    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,p:double>>)")
    least = F.create_map(*(F.lit(x) for k in MORE for x in (KINDS.index(k), model.thresholds[k])))
    judged = F.filter(model.score("proposed"), lambda s: s["p"] >= F.element_at(least, s["kind"]))
    df = df.withColumn("scored", F.when(F.size("proposed") > 0, judged).otherwise(none))

    def fixed(k: str) -> Column:
        return F.transform(f"s_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(k)).alias("kind")))

    df = df.withColumn("fixed", F.concat(*map(fixed, BASE)))
    more = F.when(F.size("scored") > 0, select([f"s_{k}" for k in BASE], "scored")).otherwise(none)
    return df.select("doc_id", "text", *(f"s_{k}" for k in BASE), "fixed", more.alias("more"))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets;
    where spans overlap, the union is replaced under the first one's kind."""
    df = find_pii(docs, model, id_col, text_col)
    spans = F.array_sort(F.concat(F.transform("fixed", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), F.transform("more", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        more = F.when(s["start"] >= a["at"], F.concat(gap, F.get(names, s["kind"]))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], more).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return df.select("doc_id", F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))).alias("text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = find_pii(docs, train(spark))
    more = F.transform("more", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return df.select(
        "doc_id",
        *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(F.col("fixed")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("fixed", more)).alias("spans"),
        (F.size("fixed") + F.size("more")).cast("long").alias("n_spans"),
        F.size(F.filter("more", lambda s: s["kind"] == KINDS.index("secret"))).cast("long").alias("n_secret"),
    )
