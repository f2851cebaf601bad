"""Plain Python versions of the operators, written without looking at how the operators work."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def id_key(id):
    return (id is not None, id or 0)


def exact(rows):
    """rows (id, text) -> (id, keep, size, kept, sha)"""
    groups = defaultdict(list)
    for id, text in rows:
        groups[lower(text)].append(id)
    out = []
    for id, text in rows:
        ids = groups[lower(text)]
        keep = max(ids, key=id_key)
        out.append((id, keep, len(ids), id == keep, sha256(lower(text))))
    return out


def fingerprint(text):
    found = words(lower(text))
    if not found:
        return 0
    shingles = [found[i : i + 3] for i in range(len(found) - 2)] or [found]
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(values, near):
    """value -> smallest value reachable"""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in listed}


def near_copies(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = component_of(set(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for (id, _), p in zip(rows, prints, strict=True):
        if id is not None:
            least[root[p]].append(id)
    return [(id, f"{p:016x}", min(least[root[p]], default=None)) for (id, _), p in zip(rows, prints, strict=True)]


def measures(text):
    text = text or ""
    found = words(text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {j for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_capitals": sum(c.isupper() and __import__("unicodedata").category(c) == "Lu" for c in text),
        "n_exclaims": text.count("!"),
        "n_distinct": len(set(found)),
        "n_lines": len(lines),
    }


def base_failed(m):
    return m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]


def vote(rule, m):
    from caseloom.llm.weak_rules import RULES

    measure, direction, good, bad = RULES[rule]
    if not m["n_words"]:
        return 0
    value = eval(measure, {"greatest": max}, m)
    if direction == "up to":
        return 1 if value <= good else -1 if value >= bad else 0
    return 1 if value >= good else -1 if value <= bad else 0


def quality(texts):
    """EM over documents one by one; the verdicts"""
    from caseloom.llm.weak_rules import ACCURACY, HIGH, LOW, PRIOR, ROUNDS, RULES

    measured = [measures(t) for t in texts]
    cast = [[vote(r, m) for r in RULES] for m in measured]
    used = [v for v, m in zip(cast, measured, strict=True) if not base_failed(m)]
    prior, accuracy = PRIOR, [ACCURACY] * len(RULES)

    def good(votes):
        odds = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True))
        return 1 / (1 + math.exp(-odds))

    for _ in range(ROUNDS if used else 0):
        p = [good(v) for v in used]
        prior_next = min(HIGH, max(1 - HIGH, sum(p) / len(p)))
        rates = []
        for k in range(len(RULES)):
            spoken = [(q, v[k]) for q, v in zip(p, used, strict=True) if v[k]]
            right = sum(q if x == 1 else 1 - q for q, x in spoken)
            rates.append(min(HIGH, max(LOW, right / len(spoken))) if spoken else ACCURACY)
        prior, accuracy = prior_next, rates
    return [(m, not base_failed(m) and good(v) >= 0.5) for m, v in zip(measured, cast, strict=True)]


def targets(sizes):
    """source -> size; resharing what is above three times the size until none is"""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above or not total:
            return target
        full |= above


def offset(source, seed=1):
    key = f"{'n' if source is None else 's' + source}:{seed}"
    return int(hashlib.md5(key.encode()).hexdigest()[:5], 16) / (1 << 20)


def mix(rows):
    """rows (id, text, source) -> (id, source, size, source_size, target, copies, taken)"""
    sized = [(id, s, len(words(t))) for id, t, s in rows]
    totals = Counter()
    for _, s, n in sized:
        totals[s] += n
    goal, out = targets(dict(totals)), []
    for s in totals:
        mine = sorted((r for r in sized if r[1] == s), key=lambda r: (-r[2], id_key(r[0])))
        each = goal[s] / totals[s] if totals[s] else 0.0
        for i, (id, _, n) in enumerate(mine):
            c = math.floor((i + 1) * each + offset(s)) - math.floor(i * each + offset(s))
            out.append((id, s, n, totals[s], goal[s], c, c * n))
    return out
