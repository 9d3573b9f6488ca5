"""Plain Python versions of operators, for tests: small, slow, and written apart from the library's code."""

from __future__ import annotations

import datetime
import hashlib
import statistics

import regex

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def quality(rows):
    """kept of rows (text, source), by the default rules."""
    flags = []
    for text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        again = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)} if len(set(grams)) < len(grams) else set()
        lines = [x for x in t.split("\n") if WORD.search(x)]
        symbols, bangs = sum(c in "#*$%&|<>" for c in t), t.count("!")
        base = len(w) < 10 or 100 * len(again) > 20 * len(w)
        grave = 100 * symbols > 20 * len(w) or 100 * bangs > 40 * len(w)
        mean = sum(map(len, w)) / max(len(w), 1)
        mild = 100 * symbols > 10 * len(w) or len(lines) - len(set(lines)) >= 3 or not 2 <= mean <= 18
        flags.append((base, grave, mild))
    hosts = {}
    for (_, source), f in zip(rows, flags, strict=True):
        hosts.setdefault(source, []).append(any(f))
    n = len(rows)
    m = sum(sum(v) for v in hosts.values()) / n if n else 0.0
    rates = [sum(v) / len(v) for v in hosts.values()]
    var = statistics.variance(rates) if len(rates) > 1 else None
    k = min(max(m * (1 - m) / var - 1, 1.0), 1e6) if var else 1e6 if var == 0 else 1.0
    shrunk = {h: (sum(v) + k * m) / (len(v) + k) for h, v in hosts.items()}
    return [not (b or g or (mi and shrunk[s] > 0.5)) for (_, s), (b, g, mi) in zip(rows, flags, strict=True)]


def components(texts, size, pct):
    """The first index of each text's component, by all pairs; and the sizes of the shingle sets."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= pct * large and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def _sha(key, *parts):
    return hashlib.sha256("|".join([key, *parts, key]).encode()).hexdigest()


def _num(hexes):
    return int(hexes[:15], 16)


def feistel(d, key, tweak):
    half = len(d) // 2
    a, b = d[:half], d[half:]
    for r in range(1, 9):
        n = len(a)
        a, b = b, str((int(a) + _num(_sha(key, tweak, str(r), str(n), b))) % 10**n).zfill(n)
    return a + b


def feistel_chars(t, letters, key, tweak):
    half = len(t) // 2
    a, b = t[:half], t[half:]
    for r in range(1, 9):
        a, b = b, "".join(letters[(letters.index(c) + _num(_sha(key, tweak, str(r), str(i + 1), str(len(a)), b))) % len(letters)] for i, c in enumerate(a))
    return a + b


def below(v, size, width, key, tweak):
    step = lambda x: int(feistel(str(x).zfill(width), key, tweak))
    v = step(v)
    while v >= size:
        v = step(v)
    return v


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(t):
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97


def refill(form, chars, cls="[0-9]"):
    left = iter(chars)
    return regex.sub(cls, lambda _: next(left), form)


def pseudonym(m, key, forms):
    """One match of the operator's pattern; forms: kind -> pattern, in order."""
    kind = next(k for k, p in forms.items() if regex.fullmatch(p, m))
    d = regex.sub("[^0-9]", "", m)
    if kind == "email":
        local, domain = m.rsplit("@", 1)
        local = local.lower()
        letters = "abcdefghijklmnopqrstuvwxyz0123456789"
        if not regex.fullmatch(r"[a-z0-9._%+\-]+", local):
            return None
        return refill(local, feistel_chars(regex.sub("[^a-z0-9]", "", local), letters, key, "email"), "[a-z0-9]") + "@" + domain
    if kind == "secret":
        run = regex.search("[0-9A-Fa-f]{12,}", m)
        return m[: run.start()] + feistel_chars(run.group().lower(), "0123456789abcdef", key, "secret") + m[run.end() :]
    if kind == "iban":
        c = m.replace(" ", "")
        if mod97(c) != 1:
            return m
        inner = regex.sub("[^0-9]", "", c[4:])
        rest = refill(c[4:], feistel(inner, key, "iban") if len(inner) > 1 else inner)
        check = str(98 - mod97(c[:2] + "00" + rest)).zfill(2)
        return refill(m, check + regex.sub("[^0-9]", "", rest))
    if kind == "phone":
        country = regex.match(r"\+([0-9]{1,3})(?=[ .\-(])", m)
        n = len(country.group(1)) if country else 1
        return refill(m, d[:n] + feistel(d[n:], key, "phone")) if len(d) >= 8 else m
    if kind == "ip":
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255:
            return m
        v = below(int.from_bytes(bytes(parts), "big"), 1 << 32, 10, key, "ip")
        return ".".join(map(str, v.to_bytes(4, "big")))
    if kind == "date":
        first = datetime.date(1900, 1, 1)
        for f in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y"):
            try:
                day = datetime.datetime.strptime(m, f).date()
            except ValueError:
                continue
            i = (day - first).days
            return (first + datetime.timedelta(below(i, 73_049, 5, key, "date"))).strftime(f) if 0 <= i < 73_049 else m
        return m
    if kind == "ssn":
        ok = lambda x: not regex.match("000|666|9|.{3}00|.{5}0000", x)
        if not ok(d):
            return m
        d = feistel(d, key, "ssn")
        while not ok(d):
            d = feistel(d, key, "ssn")
        return refill(m, d)
    if luhn(d):
        return m
    body = d[0] + feistel(d[1:-1], key, "card")
    return refill(m, body + str(-luhn(body + "0") % 10))


def alnum_words(text):
    out, run = [], []
    for c in [*(text or "").lower(), " "]:
        if c.isalnum():
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def contaminated(texts, items, d):
    """For each text the passages that match within twice their length, and those that match within any window's surroundings.

    d is the operator's module: its thresholds, and its hash of words, by which ties between telling words are broken.
    """
    import math

    import numpy as np

    table = d.word_table()
    hashed = {}

    def of(words):
        for w in set(words) - hashed.keys():
            hashed[w] = tuple(int(x[0]) for x in d.bins_of([w], table)[:2])
        return [hashed[w] for w in words]

    docs = [alnum_words(t) for t in texts]
    freq = {}
    for w in docs:
        for b in {b for _, b in of(w)}:
            freq[b] = freq.get(b, 0) + 1
    weight = lambda b: np.float32(max(math.log((1 + len(texts)) / (1 + max(freq.get(b, 0), 1))), d.FLOOR))
    passages = []
    for item in items:
        p = alnum_words(item)
        if len(p) >= d.MIN_WORDS:
            first = sorted(zip(of(p), p, strict=True), key=lambda x: (-weight(x[0][1]), x[0][0]))[: max(d.TELLING, len(p) // d.TELLING)]
            passages.append((p, {w for _, w in first}))
        else:
            passages.append((p, set()))
    out = []
    for reach in (lambda n: 2 * n, lambda n: d.SCALES[-1] + 2 * n):
        sets = []
        for w in docs:
            held, hit = set(w), set()
            for j, (p, telling) in enumerate(passages):
                if not telling or len(telling & held) < d.MIN_ANSWER * len(telling):
                    continue
                for s in range(len(w)):
                    if w[s] in telling or reach(1) != 2:
                        near = w[s : s + reach(len(p))]
                        if len(telling.intersection(near)) >= d.MIN_ANSWER * len(telling) and lcs(p, near) >= d.MIN_LCS * len(p):
                            hit.add(j)
                            break
            sets.append(hit)
        out.append(sets)
    return out
