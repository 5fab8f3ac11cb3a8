"""Plain single-process versions of the operators, as slow as they are obvious."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def decontamination(docs, items, window=10):
    """doc_id -> (n_words, n_hit, n_items, items_sha256)."""
    windows = {}
    for ident, text in items:
        words = ALNUM.findall((text or "").translate(ASCII_LOWER))
        for s in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[s : s + window]), set()).add(str(ident))
    lengths = {len(k) for k in windows}
    out = {}
    for ident, text in docs:
        words = ALNUM.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(words) - n + 1):
                if (key := tuple(words[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[key]
        out[ident] = (len(words), len(hit), len(found), sha(",".join(sorted(found))))
    return out


def shingles(text, k=5):
    words = SPACED.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_duplicates(docs, percent=85):
    """doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids, holders = sorted(sets), {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    for d in ids:
        counts = {}
        for s in sets[d]:
            for e in holders[s]:
                if e < d:
                    counts[e] = counts.get(e, 0) + 1
        for e, both in counts.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}


def substring_dedup(docs, window=20):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for ident, text in sorted(docs):
        words = SPACED.findall(text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = [x for i, x in enumerate(words) if i not in gone]
        out[ident] = (len(words), len(gone), sha(" ".join(kept)))
    return out


def line_flags(line: bytes, head: bool, last: bool):
    """A line's features, one by one."""
    size = max(len(line), 1)
    spaces, letter = b" \t\n\v\f\r", lambda c: 65 <= c <= 90 or 97 <= c <= 122
    groups = [
        lambda c: 65 <= c <= 90,
        lambda c: 97 <= c <= 122,
        lambda c: 48 <= c <= 57,
        lambda c: c in spaces,
        lambda c: c in b",.",
        lambda c: c in b"!?",
        lambda c: 33 <= c <= 127 and not letter(c) and not 48 <= c <= 57 and c not in b",.!?",
        lambda c: c >= 128,
    ]
    counts = [sum(map(g, line)) for g in groups]
    shares = [n / size for n in counts]
    shares.append(counts[0] / max(counts[0] + counts[1], 1))
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", line)
    folded = [x.lower() for x in words]
    many = max(len(words), 1)
    plain_end = lambda c: letter(c) or 48 <= c <= 57 or c >= 128 or c in b",."
    shares += [
        sum(a == b for a, b in zip(folded, folded[1:], strict=False)) / many,
        1 - len(set(folded)) / many,
        sum(not plain_end(x[-1]) for x in words) / many,
        sum(len(x) == 1 for x in words) / many,
        sum(len(x) <= 3 for x in words) / many,
        sum(len(x) >= 9 for x in words) / many,
    ]
    mean = sum(map(len, words)) / many
    out = [s > c for c in (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75) for s in shares]
    return [*out, *(mean > c for c in (2, 3, 4, 5, 6, 8, 10, 14)), *(len(words) > c for c in (0, 3, 8, 16, 32, 64, 128, 256)), head, last]


def chain_chances(unary, pairs):
    """Chances of label 1 along one chain, by sums over prefixes and suffixes."""
    import math

    n, gain = len(unary), [[math.exp(pairs[x][y]) for y in (0, 1)] for x in (0, 1)]
    ahead, back = [[1.0, math.exp(unary[0])]], [[1.0, 1.0]]
    for u in unary[1:]:
        p = ahead[-1]
        new = [sum(p[x] * gain[x][y] for x in (0, 1)) * (math.exp(u) if y else 1.0) for y in (0, 1)]
        ahead.append([v / sum(new) for v in new])
    for u in unary[:0:-1]:
        q = back[-1]
        new = [sum(gain[x][y] * (math.exp(u) if y else 1.0) * q[y] for y in (0, 1)) for x in (0, 1)]
        back.append([v / sum(new) for v in new])
    back.reverse()
    return [ahead[t][1] * back[t][1] / sum(ahead[t][y] * back[t][y] for y in (0, 1)) for t in range(n)]


def quality_score(text, field):
    """The score of one text by a fitted field."""
    import math

    lines = (text or "").encode().split(b"\n")
    flags = [line_flags(x, k == 0, k == len(lines) - 1) for k, x in enumerate(lines)]
    gives = [[sum(float(v) for f, v in zip(own, field.weights[:, k], strict=True) if f) for k in range(3)] for own in flags]
    unary = [gives[t][0] + field.constant + (gives[t - 1][1] if t else 0.0) + (gives[t + 1][2] if t + 1 < len(lines) else 0.0) for t in range(len(lines))]
    chances = chain_chances(unary, field.pairs)
    lengths = [len(x) + 1 for x in lines]
    q = min(max(sum(c * n for c, n in zip(chances, lengths, strict=True)) / sum(lengths), 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(field.scale * math.log(q / (1 - q)) + field.shift)))


def auc(scores, labels):
    """The share of pairs of a 1 and a 0 in which the 1 scores higher; ties count half."""
    ones, zeros = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        total += sum(map(int, str(int(c) * (1 + k % 2))))
    return total % 10 == 0


def personal_spans(text):
    """(start, place of the kind, end) of the base spans."""
    out = []
    for k, (kind, pattern) in enumerate(PERSONAL.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """(codes and errors of rows (id, vector), codebooks), by plain loops."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in sorted(ints)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        held = {}
        for _, v in ints:
            for p in range(parts):
                held.setdefault((p, near(v, p)), []).append(cut(v, p))
        for (p, e), own in held.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [[near(v, p) for p in range(parts)] for _, v in ints]
    return [(i, "".join(f"{e:02x}" for e in c), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(c))) for (i, v), c in zip(ints, codes, strict=True)], books


def ranked(docs, items, k=20):
    """(item, rank, doc_id, score) of the items (id, text) over the documents (id, text)."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: term.findall((t or "").translate(ASCII_LOWER))
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total, holding, out = len(bags), sum(len(b) for _, b in bags), {}, []
    for _, b in bags:
        for t in set(b):
            holding[t] = holding.get(t, 0) + 1
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 100 - 25 + 25 * len(b) * n // total
            score = 0
            for t in terms(text):
                if tf := b.count(t):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return out
