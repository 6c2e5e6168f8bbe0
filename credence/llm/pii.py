"""Personal data: rules for what has a fixed form, and a character tagger for the rest.

Rules find email addresses, ip addresses, card numbers and phone numbers whose form
they can prove. A character-level bidirectional LSTM with CRF transitions, trained in
numpy from labelled spans, adds what the rules miss: numbers run together with other
digits, written without their mark, or with their marks spelt out. Texts of any length
are laid over with windows that overlap by half; scores of windows that overlap are
averaged with weights that fall towards a window's ends, and each stretch of windows is
then decoded as one sequence, so that a span across a border is found once and whole.
Windows without a digit, an at sign or one spelt out in brackets ("[at]", "( AT )") are
not scored; so an address in words alone ("jo at mail dot com") is not found. A span of the tagger stays
if it meets no span of the rules and passes the same proof as its kind (a card its
checksum, an ip its ranges, a phone its number of digits).

Defined results: null and empty texts have no spans; texts may have any length; equal
rows get equal spans; an empty table gives an empty one; ties between kinds go by the
order of KINDS; other columns pass through untouched in ``redact``.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from credence.llm.bilstm_crf import BiLstmCrf
from credence.llm.common import begin, bound_batches, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]|[\[(] ?at ?[\])]", re.IGNORECASE)
#: Characters of a window, and how far the next one is.
WINDOW, STRIDE = 128, 64
#: The tagger's training: labelled texts, steps, seed.
TRAIN = (3000, 260, 11)


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time that grows with the text alone."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            out.append((begin, found.end()))
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def rule_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of each kind by the rules; matches that fail their proof are dropped."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = email_spans(text)
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := digits_of(m.group())) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


# --- the tagger ---------------------------------------------------------------

MARKS = " \n!\"#$%&'()*+,-./:;<=>?@[]_|"


def classes(text: str) -> np.ndarray:
    """Class of each character: 1 other, 2 other letter, 3 capital, 4 digit, then a-z, then marks."""
    return np.array([_class(c) for c in text], np.int16)


@functools.lru_cache(maxsize=4096)
def _class(c: str) -> int:
    if "0" <= c <= "9":
        return 4
    if "a" <= c <= "z":
        return 5 + ord(c) - 97
    if c in MARKS:
        return 31 + MARKS.index(c)
    return 3 if c.isupper() else 2 if c.isalpha() else 1


N_CLASSES = 31 + len(MARKS)


def _with_check(rng, n: int) -> str:
    body = "".join(map(str, rng.integers(0, 10, n - 1)))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def labelled_text(rng) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up text of about a window's length with labelled spans, for training."""
    syllables = ("an the re ion der ment que con la en st ver os ou ai lich".split(), "tion ed ing er or au ch es ue it sh al".split())

    def word() -> str:
        w = "".join(str(rng.choice(syllables[int(rng.integers(2))])) for _ in range(int(rng.integers(1, 4))))
        return w.capitalize() if rng.random() < 0.15 else w

    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def email() -> str:
        at, dot = [("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]")][int(rng.integers(5))]
        name = word().lower() + (["", ".", "_", "-"][int(rng.integers(4))] + word().lower()) * (rng.random() < 0.5) + number(int(rng.integers(0, 3)))
        return name + at + word().lower() + number(int(rng.integers(0, 2))) + (dot + "example") * (rng.random() < 0.5) + dot + str(rng.choice(["com", "org", "net", "de", "fr"]))

    def ip() -> str:
        sep = [".", ".", " . ", "[.]"][int(rng.integers(4))]
        return sep.join(str(int(x)) for x in rng.integers(0, 256, 4))

    def card() -> str:
        d, sep = _with_check(rng, 16), ["", "", " ", "-", "."][int(rng.integers(5))]
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        form = ["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+49 {} {}{}", "{}.{}.{}", "+1-{}-{}-{}", "00 33 {} {} {}"]
        return form[int(rng.integers(len(form)))].format(a, b, c)

    def other() -> str:
        kind = int(rng.integers(7))
        if kind == 0:
            return number(int(rng.integers(1, 14)))
        if kind == 1:
            return f"{number(int(rng.integers(1, 4)))}.{number(int(rng.integers(1, 3)))}"
        if kind == 2:
            return "20" + number(2) + "-" + number(2) + "-" + number(2)
        if kind == 3:
            return "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(16, 40))))
        if kind == 4:
            return 'token = "' + "".join(rng.choice(list("0123456789abcdef"), 24)) + '"'
        if kind == 5:
            return number(2) + ":" + number(2)
        return "v" + number(1) + "." + number(1) + "." + number(1)

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out, spans, n = "", [], 0
    while n < 40 or rng.random() < 0.5 and n < 90:
        r = rng.random()
        if r < 0.16:
            kind = KINDS[int(rng.integers(4))]
            made = makers[kind]()
            spans.append((kind, n, n + len(made)))
        elif r < 0.3:
            made = other()
        else:
            made = word() + ["", "", "", ".", ",", " |", "!"][int(rng.integers(7))]
        out += made + ("\n" if rng.random() < 0.04 else " ")
        n = len(out)
    return out, spans


def labels(spans: list[tuple[str, int, int]], n: int) -> np.ndarray:
    """Tags of characters: 0 outside, 1 + 2k at the start of a span of kind k, 2 + 2k inside."""
    y = np.zeros(n, np.int8)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a : a + 1] = 1 + 2 * k
    return y


@functools.lru_cache(maxsize=2)
def tagger(train: tuple[int, int, int] = TRAIN) -> BiLstmCrf:
    """The trained tagger; it is made on the driver and goes to the workers as it is."""
    n, steps, seed = train
    rng = np.random.default_rng(seed)
    width = 96
    x, y = np.zeros((n, width), np.int16), np.zeros((n, width), np.int8)
    for i in range(n):
        text, spans = labelled_text(rng)
        cut = int(rng.integers(0, 12)) if rng.random() < 0.3 else 0  # windows begin anywhere
        c, t = classes(text)[cut : cut + width], labels(spans, len(text))[cut : cut + width]
        x[i, : len(c)], y[i, : len(t)] = c, t
    return BiLstmCrf(N_CLASSES, 1 + 2 * len(KINDS), seed=seed).fit(x, y, steps, seed=seed)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text covered by neighbouring windows that hold a digit or an at sign."""
    out: list[list[int]] = []
    n, at = len(text), 0
    while found := MARK.search(text, at):
        first = max(0, (found.start() - WINDOW) // STRIDE + 1)
        last = found.start() // STRIDE
        begin, end = first * STRIDE, min(n, last * STRIDE + WINDOW)
        if out and begin <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([begin, end])
        at = max(found.end(), (found.start() // STRIDE + 1) * STRIDE)
    return [(a, b) for a, b in out]


def tag_spans(model: BiLstmCrf, parts: list[str], batch: int = 256) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger in each stretch of text: windows are scored, reconciled, and decoded as a whole."""
    weight = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
    jobs = [(i, a) for i, part in enumerate(parts) for a in range(0, max(1, len(part) - WINDOW + STRIDE), STRIDE)]
    coded = [classes(p) for p in parts]
    k = model.tags
    total = [np.zeros((len(p), k), np.float32) for p in parts]
    mass = [np.zeros((len(p), 1), np.float32) for p in parts]
    for j in range(0, len(jobs), batch):
        some = jobs[j : j + batch]
        x = np.zeros((len(some), WINDOW), np.int16)
        for r, (i, a) in enumerate(some):
            c = coded[i][a : a + WINDOW]
            x[r, : len(c)] = c
        em = model.emissions(x)
        for r, (i, a) in enumerate(some):
            m = min(WINDOW, len(parts[i]) - a)
            total[i][a : a + m] += em[r, :m] * weight[:m, None]
            mass[i][a : a + m] += weight[:m, None]
    out: list[list] = [[] for _ in parts]
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    for j in range(0, len(order), 64):
        some = [i for i in order[j : j + 64] if len(parts[i])]
        if not some:
            continue
        lengths = np.array([len(parts[i]) for i in some])
        em = np.zeros((len(some), int(lengths.max()), k), np.float32)
        for r, i in enumerate(some):
            em[r, : lengths[r]] = total[i] / mass[i]
        for r, tags in enumerate(model.decode(em, lengths)):
            out[some[r]] = spans_of(tags)
    return out


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, begin, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        k = (t - 1) // 2 if t else -1
        if begin >= 0 and (k != kind or t % 2):
            out.append((KINDS[kind], begin, i))
            begin = -1
        if k >= 0 and begin < 0:
            begin, kind = i, k
    return out


def proven(kind: str, found: str) -> bool:
    """Whether the text of a span of the tagger is of its kind."""
    digits = digits_of(found)
    if kind == "email":
        plain = re.sub(r"(?i)\s*[\[(] ?at ?[\])]\s*", "@", re.sub(r"(?i)\s*[\[(] ?dot ?[\])]\s*", ".", found))
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain) is not None
    if kind == "ip":
        plain = re.sub(r"\s*\[?\.\]?\s*", ".", found)
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain) is not None and all(int(x) <= 255 for x in plain.split("."))
    if kind == "card":
        return re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", found) is not None and 16 <= len(digits) <= 19 and luhn(digits)
    return re.fullmatch(r"\+?[0-9(][ ().0-9-]+[0-9]", found) is not None and 10 - 2 * (found[0] == "+") <= len(digits) <= 15 and len(digits) < len(found.lstrip("+"))


def find(batch: list[str], model: BiLstmCrf) -> list[tuple[list, list]]:
    """(spans of the rules, all spans) of each text, as (kind, start, end) by kind, then start."""
    rules, parts, where = [], [], []
    for i, text in enumerate(batch):
        rules.append([(k, a, b) for k, spans in rule_spans(text).items() for a, b in spans])
        for a, b in stretches(text):
            parts.append(text[a:b])
            where.append((i, a))
    added: list[list] = [[] for _ in batch]
    for (i, offset), spans in zip(where, tag_spans(model, parts)):
        for kind, a, b in spans:
            a, b = a + offset, b + offset
            while a < b and batch[i][a] in " \n.,|!":
                a += 1
            while b > a and batch[i][b - 1] in " \n.,|!":
                b -= 1
            if b > a and proven(kind, batch[i][a:b]) and not any(x < b and a < y for _, x, y in [*rules[i], *added[i]]):
                added[i].append((kind, a, b))
    order = {k: j for j, k in enumerate(KINDS)}
    return [(base, sorted([*base, *more], key=lambda s: (order[s[0]], s[1]))) for base, more in zip(rules, added)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", train: tuple[int, int, int] = TRAIN) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); the counts are of the rules' spans."""
    model = tagger(train)

    def run(batches):
        begin("pii")
        for batch in batches:
            found = find(texts(batch.column(1)), model)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            added = pa.array([len(all_) - len(base) for base, all_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, digest, pa.array([listed(a) for _, a in found], pa.string()), added],
                ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    bound_batches(df.sparkSession)
    schema = f"key {dict(df.dtypes)[key]}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long"
    return df.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def redact(df: DataFrame, text: str = "text", train: tuple[int, int, int] = TRAIN) -> DataFrame:
    """The rows of ``df``, each span in the text replaced with its kind in brackets; null stays null."""
    model, names = tagger(train), df.columns
    at = names.index(text)

    def run(batches):
        begin("pii")
        for batch in batches:
            given = batch.column(at).to_pylist()
            out = []
            for t, (_, spans) in zip(given, find([t or "" for t in given], model)):
                out.append(t if not spans else replaced(t, spans))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """A text with its spans replaced; of spans that overlap, one mark stands for all, named by the first."""
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])
