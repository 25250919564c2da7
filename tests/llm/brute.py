"""Plain versions of the operators, for small tables held in memory."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(UPPER)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ngram_components(docs, n=4, percent=85):
    """docs: (doc_id, text) -> {doc_id: (set size, component)}."""
    sets = {}
    for doc_id, text in docs:
        words = BLANK_WORD.findall(lower(text))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
        sets[doc_id] = grams
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    counts = Counter()
    seen_ids = sorted(sets)
    for d in seen_ids:
        counts.clear()
        for g in sets[d]:
            for e in holders[g]:
                if e < d:
                    counts[e] += 1
        for e, both in counts.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def contamination(docs, benchmark, window=10):
    """(doc_id, text), (item_id, text) -> {doc_id: (n_words, n_hit, n_items, sha)}."""
    items = defaultdict(set)
    for item, text in benchmark:
        words = ALNUM_WORD.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            items[tuple(words[i : i + size])].add(item)
    sizes = {len(w) for w in items}
    out = {}
    for doc_id, text in docs:
        words = ALNUM_WORD.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                got = items.get(tuple(words[i : i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        names = sorted(str(x) for x in found)
        out[doc_id] = (len(words), len(hit), len(found), sha256(",".join(names)))
    return out


def base_quality(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    inside = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed,
    )


def line_verdicts(docs, max_docs=10, min_words=10, min_left=0.3):
    """(doc_id, source, text) -> {doc_id: (base figures..., kept)}."""
    digits = str.maketrans("123456789", "000000000")

    def lines_of(text):
        out = Counter()
        for line in (text or "").split("\n"):
            words = BLANK_WORD.findall(lower(line).translate(digits))
            if words:
                out[" ".join(words)] += len(words)
        return out

    texts = defaultdict(set)
    for _, source, text in docs:
        texts[source].add(text)
    holders = Counter()
    for source, own in texts.items():
        for text in own:
            holders.update((source, line) for line in lines_of(text))
    out = {}
    for doc_id, source, text in docs:
        *figures, failed = base_quality(text)
        common = sum(n for line, n in lines_of(text).items() if holders[source, line] > max_docs)
        left = figures[0] - common
        out[doc_id] = (*figures, failed, not failed and left >= min_words and left >= min_left * figures[0])
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii_spans(text):
    """{kind: [(start, end)]} by the base patterns."""
    text = text or ""
    only = lambda v: re.sub("[^0-9]", "", v)
    good = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 16 <= len(only(v)) <= 19 and luhn(only(v)),
        "phone": lambda v: 8 <= len(only(v)) <= 15,
    }
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return {k: [m.span() for m in re.finditer(p, text) if good[k](m[0])] for k, p in patterns.items()}


def pii_row(text):
    spans = pii_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in spans[k])
    return (*[len(spans[k]) for k in ("email", "ip", "card", "phone")], sha256(joined), joined)


def secret_row(text):
    text = text or ""
    names = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    found = {
        "assign": [m.span() for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32],
    }
    order = sorted((a, i, f"{k}:{a}:{b}") for i, k in enumerate(found) for a, b in found[k])
    joined = ",".join(x for *_, x in order)
    return (*[len(v) for v in found.values()], sha256(joined), joined)


def is_random(value, pairs, readable):
    if not (re.search("[A-Za-z]", value) and re.search("[0-9]", value)) or len(set(value)) < 10:
        return False
    is_hex = re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)
    alphabet = 16 if is_hex else 62 if re.search("[a-z]", value) and re.search("[A-Z]", value) else 36
    same = sum(a == b for i, a in enumerate(value) for b in value[:i])
    if same * alphabet > len(value) * (len(value) - 1):
        return False
    lower, paired, i = value.lower(), 0, 0
    while i < len(lower):
        hit = lower[i : i + 2] in pairs
        paired, i = paired + 2 * hit, i + 1 + hit
    return bool(is_hex) or 100 * paired < readable * sum(c.isalpha() for c in value)


def mix_targets(sizes, weights=(5, 2, 1), repeats=3):
    """{source: size} -> {source: target}, by sharing what is left again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, Fraction(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > repeats * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = Fraction(repeats * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def url_rule(url, rules):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(UPPER)
    fits = [(len(h + p), h + p, act) for act, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))
