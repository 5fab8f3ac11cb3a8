"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

Candidates.  One scan of each whole text finds the base matches of the kinds
(email, ip, card, phone) and further forms that they miss: a card or a phone
inside a longer run of numbers whose match as a whole fails, national phone
numbers, addresses written with "at" and "dot", and the failed matches themselves.

Labelers.  Each says yes, no or nothing of a candidate: the strict pattern of its
kind, its checksum or ranges, a gazetteer (top-level domains, calling codes, card
issuers, special networks), words before and after it, and whether it stands free.

Aggregation.  Votes, form and length make a small code, so the corpus comes down to
one count for each code (``CODES`` of them at most), over all candidates of all
documents.  Expectation-maximisation on these counts estimates, without any label,
how often each labeler says what of personal data and of other spans, and how
common personal data is among each form.  From the posteriors it gives, a logistic
classifier of votes, form and length is trained, on the same counts: every
candidate takes part.  A span that isn't a base match is added where the classifier
gives it 0.5 or more and it meets no base span and no better added one.

All classes of characters are decided by bytes and found with numpy in time
proportional to the text, whatever it is made of.  Texts are scanned once and
never shuffled; the written spans are small.

Edge cases: null text is empty; base matches are leftmost and don't overlap within
a kind, and failing ones are dropped without another try; rows with one id are
judged each for itself; numbers of any length are handled; an empty table gives no
rows, and a corpus without candidates a model that adds nothing.  Offsets are in
code points, the end exclusive.  Counts and base_sha256 are of base spans alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words as w
from lodestone.llm.tables import materialize

KINDS = ("email", "ip", "card", "phone")
#: Forms of candidates, and the kind of each.
FORMS = {"email": "email", "ip": "ip", "card": "card", "phone": "phone", "card within": "card", "phone within": "phone", "national phone": "phone", "written email": "email"}
_FORM = {name: k for k, name in enumerate(FORMS)}
_KIND = [KINDS.index(kind) for kind in FORMS.values()]
LABELERS = ("pattern", "check", "gazetteer", "before", "after", "free")
ABSTAIN, YES, NO = 0, 1, 2
#: Digits (of an address: characters) of a candidate fall into one of these lengths.
LENGTHS = (8, 12, 16, 24)
#: Distinct codes there can be.
CODES = len(FORMS) * 3 ** len(LABELERS) * (len(LENGTHS) + 1)
#: Digits that a card and a phone have.
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
#: Bytes around a span in which words count.
BEFORE, AFTER = 40, 16

# Gazetteers, in their natural order.
TOP_LEVEL = frozenset(b"com org net edu gov mil int info biz io dev app co me tv ai cloud online site xyz arpa example test local at au be br ca ch cn cz de dk es eu fi fr gr hu ie il in it jp kr mx nl no nz pl pt ro ru se sg sk tr ua uk us za".split())
CALLING = tuple(b"1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 852 853 880 886 960 961 962 963 964 965 966 968 971 972 973 974 994 995 996 998".split())
ISSUERS = tuple(b"34 35 36 37 38 4 51 52 53 54 55 60 62 64 65".split())
SPECIAL_NETWORKS = tuple(b"0. 127. 169.254. 255.".split())

_WORDS = {
    "email": b"e-?mails?|mailto|mails?|contact|contacto|kontakt|courriel|correo|write|reply",
    "ip": b"ip|ipv4|address|host|server|client|login|from|remote",
    "card": b"card|cards|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment|paid",
    "phone": b"phone|phones|tel|telephone|telefon|t\xc3\xa9l|mobile|cell|call|fax|contact|whatsapp|sms",
}
_CONTEXT = {kind: re.compile(rb"(?<![a-z0-9])(?:" + words + rb")(?![a-z0-9])") for kind, words in _WORDS.items()}
_AGAINST = re.compile(rb"(?<![a-z0-9])(?:version|release|isbn|issn|order|invoice|sku|serial|build|revision|commit|token|hash|checksum|license|section|page|figure|table)(?![a-z0-9])")

_LOCAL = w._table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"._%+-"])
_HOST = w._table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b".-"])
_DIGIT = w._table(range(0x30, 0x3A))
_DIALLED = w._table([*range(0x30, 0x3A), *b" ().-"])
_WORD = w._table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)])
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WRITTEN = re.compile(rb"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]{0,63})(?: ?[\[(]at[\])] ?| at )([A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){0,3}?(?: ?[\[(]dot[\])] ?| dot )([A-Za-z]{2,24}))(?![A-Za-z0-9-])", re.IGNORECASE)


def luhn(digits: bytes) -> bool:
    """Whether the check digit is right."""
    values = [x - 48 for x in reversed(digits)]
    return (sum(values[::2]) + sum(2 * x - 9 * (x > 4) for x in values[1::2])) % 10 == 0


def _byte_value(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) < 4 and int(part or b"0") <= 255


def _only_digits(raw: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", raw)


class Scan:
    """Candidates of the texts whose bytes stand one after another: (text, form, start, end, base), in bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.raw = data, offsets, data.tobytes()
        self.start, self.end, first = w.words(data, offsets, _DIGIT)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.found: list[tuple[int, int, int, int, bool]] = []
        self._edges = set(offsets.tolist())
        self._emails()
        self._written()
        self._addresses()
        claimed = self._phones()
        self._cards()
        self._national(claimed)

    def _add(self, form: str, start: int, end: int, base: bool) -> None:
        self.found.append((int(np.searchsorted(self.offsets, start, "right")) - 1, _FORM[form], int(start), int(end), base))

    def _runs(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, _ = w.words(self.data, self.offsets, members)
        return start, end

    def _emails(self) -> None:
        at = np.flatnonzero(self.data == ord("@"))
        if not len(at):
            return
        low, low_end = self._runs(_LOCAL)
        high, high_end = self._runs(_HOST)
        before, after = np.searchsorted(low_end, at), np.searchsorted(high, at + 1)
        done = 0
        for a, b, c in zip(at.tolist(), before.tolist(), after.tolist(), strict=True):
            if b == len(low) or low_end[b] != a or c == len(high) or high[c] != a + 1 or (a + 1) in self._edges:
                continue
            start, host = max(int(low[b]), done), _DOMAIN.match(self.raw, a + 1, int(high_end[c]))
            if start < a and host:
                done = host.end()
                self._add("email", start, done, True)

    def _written(self) -> None:
        lower = self.raw.lower()
        for i, j in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            for m in () if lower.find(b"dot", i, j) < 0 else _WRITTEN.finditer(self.raw, i, j):
                self._add("written email", m.start(), m.end(), False)

    def _chains(self, links: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the chains of digit runs joined by one of these bytes."""
        n = len(self.start)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        joined = (self.start[1:] == self.end[:-1] + 1) & (self.text[1:] == self.text[:-1]) & np.isin(self.data[self.end[:-1]], np.frombuffer(links, np.uint8))
        first = np.flatnonzero(np.concatenate([[True], ~joined]))
        return first, np.append(first[1:], n)

    def _addresses(self) -> None:
        first, end = self._chains(b".")
        for a, b in zip(first[end - first >= 4].tolist(), end[end - first >= 4].tolist(), strict=True):
            for i in range(a, b - 3, 4):
                good = all(_byte_value(self.raw[s:e]) for s, e in zip(self.start[i : i + 4].tolist(), self.end[i : i + 4].tolist(), strict=True))
                self._add("ip", self.start[i], self.end[i + 3], good)

    def _cards(self) -> None:
        first, end = self._chains(b" -")
        if not len(first):
            return
        digits = np.add.reduceat(self.end - self.start, first)
        low, high = CARD_DIGITS
        for k in np.flatnonzero(digits >= low).tolist():
            a, b = int(first[k]), int(end[k])
            start, stop = int(self.start[a]), int(self.end[b - 1])
            good = digits[k] <= high and luhn(_only_digits(self.raw[start:stop]))
            self._add("card", start, stop, good)
            if not good and b - a > 1:
                self._cards_within(a, b)

    def _cards_within(self, a: int, b: int) -> None:
        """Single runs as long as a card, and four runs of four digits, of a chain that is none."""
        sizes = (self.end[a:b] - self.start[a:b]).tolist()
        i = 0
        while i < len(sizes):
            n = 4 if sizes[i : i + 4] == [4, 4, 4, 4] else 1
            if n == 4 or CARD_DIGITS[0] <= sizes[i] <= CARD_DIGITS[1]:
                self._add("card within", self.start[a + i], self.end[a + i + n - 1], False)
            i += n

    def _phones(self) -> set[int]:
        """Numbers after a plus; gives the digit runs that they claim."""
        plus = np.flatnonzero(self.data == ord("+"))
        claimed: set[int] = set()
        if not len(plus) or not len(self.start):
            return claimed
        low, low_end = self._runs(_DIALLED)
        at, run = np.searchsorted(self.start, plus + 1), np.searchsorted(low, plus + 1)
        for p, i, k in zip(plus.tolist(), at.tolist(), run.tolist(), strict=True):
            if i == len(self.start) or self.start[i] != p + 1 or k == len(low) or low[k] != p + 1 or (p + 1) in self._edges:
                continue
            j = int(np.searchsorted(self.start, low_end[k]))
            stop = int(self.end[j - 1])
            if stop < p + 4:
                continue
            digits = int((self.end[i:j] - self.start[i:j]).sum())
            good = PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]
            self._add("phone", p, stop, good)
            if good:
                claimed.update(range(i, j))
            elif digits > PHONE_DIGITS[1]:
                total = np.cumsum(self.end[i:j] - self.start[i:j])
                n = int(np.searchsorted(total, PHONE_DIGITS[0])) + 1
                if total[n - 1] <= PHONE_DIGITS[1]:
                    self._add("phone within", p, self.end[i + n - 1], False)
                    claimed.update(range(i, i + n))
        return claimed

    def _national(self, claimed: set[int]) -> None:
        """Runs of three, three and four digits, one or two of space, dot, hyphen or brackets apart, not all of them spaces."""
        n = self.end - self.start
        if len(n) < 3:
            return
        near = self.start[1:] - self.end[:-1] <= 2
        fits = (n[:-2] == 3) & (n[1:-1] == 3) & (n[2:] == 4) & near[:-1] & near[1:] & (self.text[:-2] == self.text[2:])
        for i in np.flatnonzero(fits).tolist():
            a, b = int(self.start[i]), int(self.end[i + 2])
            inner = self.raw[int(self.end[i]) : int(self.start[i + 1])] + self.raw[int(self.end[i + 1]) : int(self.start[i + 2])]
            if set(inner) <= set(b" ().-") and set(inner) & set(b").-") and not claimed & {i, i + 1, i + 2}:
                opened = a > 0 and self.raw[a - 1 : a] == b"(" and a not in self._edges and b")" in inner
                self._add("national phone", a - opened, b, False)

    def code(self, text: int, form: int, start: int, end: int, base: bool) -> int:
        """Form, length and the labelers' votes in one number."""
        raw, name = self.raw[start:end], list(FORMS)[form]
        kind = FORMS[name]
        digits = _only_digits(raw)
        pattern = YES if base else NO if name == kind else ABSTAIN
        gazetteer = ABSTAIN
        if kind == "email":
            tail = re.split(rb"[.@ )\]]", raw)[-1]
            check = YES if tail.isalpha() and len(tail) > 1 and (name == "email" or tail.lower() in TOP_LEVEL) else NO
            gazetteer = YES if tail.lower() in TOP_LEVEL else NO
        elif kind == "ip":
            check = YES if all(map(_byte_value, raw.split(b"."))) else NO
            gazetteer = NO if raw.startswith(SPECIAL_NETWORKS) else ABSTAIN
        elif kind == "card":
            check = YES if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits) else NO
            gazetteer = YES if digits.startswith(ISSUERS) else ABSTAIN
        else:
            least = PHONE_DIGITS[0]
            check = YES if least <= len(digits) <= PHONE_DIGITS[1] else NO
            gazetteer = ABSTAIN if name == "national phone" else YES if digits.startswith(CALLING) else NO
        low, high = int(self.offsets[text]), int(self.offsets[text + 1])
        ahead, behind = self.raw[max(low, start - BEFORE) : start].lower(), self.raw[end : min(high, end + AFTER)].lower()
        votes = [pattern, check, gazetteer]
        for near in (ahead, behind):
            votes.append(YES if _CONTEXT[kind].search(near) else NO if _AGAINST.search(near) else ABSTAIN)
        glued = (start > low and _WORD[self.data[start - 1]]) or (end < high and _WORD[self.data[end]])
        votes.append(NO if glued else YES)
        length = int(np.searchsorted(LENGTHS, len(raw) if kind == "email" else len(digits), "left"))
        out = form * (len(LENGTHS) + 1) + length
        for vote in votes:
            out = out * 3 + vote
        return out


def votes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form, length and votes (one column a labeler) of codes."""
    codes, out = codes.copy(), np.empty((len(codes), len(LABELERS)), np.int64)
    for k in range(len(LABELERS) - 1, -1, -1):
        out[:, k] = codes % 3
        codes //= 3
    return codes // (len(LENGTHS) + 1), codes % (len(LENGTHS) + 1), out


def scan(docs: DataFrame) -> DataFrame:
    """Written table of one row per document: doc_id and its candidates (form, start and end in code points, base, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                seen = Scan(part, at)
                found = sorted(seen.found, key=lambda x: (x[0], x[2], _KIND[x[1]], x[3]))
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                text, form, start, end, base = (np.array([x[k] for x in found], np.int64) for k in range(5))
                head = points[at[text]] if len(found) else points[:0]
                fields = {"form": form.astype(np.int8), "start": points[start] - head, "end": points[end] - head, "base": base.astype(bool), "code": np.array([seen.code(*x) for x in found], np.int32)}
                spans = pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], names=list(fields))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(j - i + 1)), pa.int32()), spans)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(run, "doc_id long, spans array<struct<form: byte, start: long, end: long, base: boolean, code: int>>"), "candidates")


def estimated(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Per code the posterior that such a span is personal data, by expectation-maximisation over the labelers' votes.

    Starts from the labelers' majority, with the check counted twice. What each labeler says of either class is estimated
    with one span of each vote added, and 2 more of yes for personal data and of no for the rest.
    """
    form, _, vote = votes(codes)
    lean = (vote == YES).sum(1) - (vote == NO).sum(1) + (vote[:, 1] == YES) - (vote[:, 1] == NO)
    chance = 1 / (1 + np.exp(-1.5 * (lean - 0.5)))
    added = np.array([[1.0, 1.0, 3.0], [1.0, 3.0, 1.0]])
    for _ in range(rounds):
        log = np.empty((2, len(codes)))
        for z, weight in enumerate((counts * (1 - chance), counts * chance)):
            share = np.bincount(form, weight, len(FORMS)) + 1
            log[z] = np.log(share / (np.bincount(form, counts, len(FORMS)) + 2))[form]
            for k in range(len(LABELERS)):
                table = np.bincount(vote[:, k], weight, 3) + added[z]
                log[z] += np.log(table / table.sum())[vote[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - chance).max(initial=0) < 1e-9:
            break
        chance = new
    return chance


def _features(codes: np.ndarray) -> np.ndarray:
    form, length, vote = votes(codes)
    columns = [np.ones(len(codes))]
    columns += [form == k for k in range(len(FORMS))] + [length == k for k in range(len(LENGTHS) + 1)]
    columns += [vote[:, k] == v for k in range(len(LABELERS)) for v in (YES, NO)]
    return np.stack(columns, 1).astype(float)


def classifier(codes: np.ndarray, counts: np.ndarray, chance: np.ndarray, rounds: int = 30, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic classifier of the features, by Newton steps on the posteriors of all counted spans."""
    x, weight = _features(codes), np.zeros(_features(codes[:0]).shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        gradient = x.T @ (counts * (p - chance)) + ridge * weight
        curvature = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weight))
        step = np.linalg.solve(curvature, gradient)
        weight = weight - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return weight


def scores(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(codes) @ weight, -30, 30)))


def fit(scanned: DataFrame) -> dict[int, float]:
    """The classifier's score of each code that the corpus has; codes and counts, ``CODES`` at most, reach the driver."""
    rows = scanned.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    codes, counts = np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)
    if not len(codes):
        return {}
    return dict(zip(codes.tolist(), scores(codes, classifier(codes, counts, estimated(codes, counts))).tolist(), strict=True))


def _chosen(spans: list[dict], score: dict[int, float]) -> list[dict]:
    """The base spans, and those that the classifier adds: best first, none that meets another."""
    base, free = [s for s in spans if s["base"]], []
    for a, b in sorted((s["start"], s["end"]) for s in base):
        if free and a <= free[-1][1]:
            free[-1] = (free[-1][0], max(free[-1][1], b))
        else:
            free.append((a, b))
    added = []
    for s in sorted((s for s in spans if not s["base"] and score.get(s["code"], 0) >= 0.5), key=lambda s: (-score[s["code"]], s["start"], s["end"], s["form"])):
        at = bisect_left(free, (s["end"], -1))
        if at == 0 or free[at - 1][1] <= s["start"]:
            insort(free, (s["start"], s["end"]))
            added.append(s)
    return sorted(base + added, key=lambda s: (s["start"], _KIND[s["form"]], s["end"]))


def spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and its spans (kind, start, end, base, score), base ones with the classifier's score too."""
    scanned = scan(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(scanned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value
        for batch in batches:
            rows = [[{"kind": KINDS[_KIND[s["form"]]], "form": s["form"], "start": s["start"], "end": s["end"], "base": s["base"], "score": score[s["code"]]} for s in _chosen(x, score)] for x in batch["spans"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, _SPANS)], names=["doc_id", "spans"])

    return scanned.mapInArrow(run, "doc_id long, spans array<struct<kind: string, form: byte, start: long, end: long, base: boolean, score: double>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("form", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of base spans, all spans, and how many the method added."""
    found = spans(docs)
    listed = lambda column: F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def _of(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)


def removed(text: str, found: list[tuple[int, int]], mask: str = "[removed]") -> str:
    """The text with the spans (start, end) replaced; overlapping ones count as one."""
    out, done = [], 0
    for a, b in sorted(found):
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join([*out, text[done:]])
