"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers by pattern. The
method reads the islands of a text that hold digits or ``@``: an island is cut in tokens, and each
run of at most ``TOKENS`` tokens is a candidate segment whose features describe the whole span (its
shape, its number of digits, checksum, separators, and what stands beside it). Dynamic programming
over segments of bounded length picks boundaries and types together; text outside of islands has no
candidates, so it splits the dynamic programme exactly. Weights are those of a conditional random
field (semi-Markov forward and backward sums), learned from islands that the base has labelled, once
as they stand and once with the ``+`` and country code of phone numbers taken away. Spans that it finds
are added where no base span of their kind overlaps them.

Null and empty texts have no spans; texts are read whole; repeated rows get equal results; an empty
table gives no rows and learns nothing; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, share_of_hash

KINDS = ("email", "ip", "card", "phone")
#: Most tokens of a segment, and most documents that weights are learned from.
TOKENS, SAMPLE = 24, 3000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HIT = re.compile(r"[0-9@]")
LATIN_DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(LATIN_DIGITS.findall(text))


def base(text: str) -> list[Span]:
    """The base spans, by kind and start."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append(("email", start, done))
        at = text.find("@", done)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def islands(text: str):
    """Ranges of words with digits or ``@``, joined where a single space stands between them."""
    start = stop = None
    at = 0
    while m := HIT.search(text, at):
        a = b = m.start()
        low = stop if stop is not None else 0
        while a > low and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if stop is not None and a - stop <= 1:
            stop = b
        else:
            if stop is not None:
                yield start, stop
            start, stop = a, b
        at = b
    if stop is not None:
        yield start, stop


#: What a feature of a span says, in the order of ``features``.
NAMES = (
    "any", "one @ with a dotted domain", "letters", "four numbers with dots", "none of them above 255", "plus first", "passes Luhn",
    "no digit", "1-3 digits", "4-7 digits", "8-9 digits", "10-11 digits", "12-15 digits", "16-19 digits", "more digits",
    "brackets", "dash", "space", "dot", "other sign", "inside a word at the left", "inside a word at the right", "joined by a sign at the left",
    "ends in a digit", "one token", "2-5 tokens", "digits in groups of other separators",
    "goes on behind a sign",
)


# What a character is, as bits.
DIGIT, LETTER, ALPHA, ALNUM, SPACE, IN_LOCAL, IN_DOMAIN = (1 << k for k in range(7))
#: Tokens whose candidates are scored at once; characters of islands that are read together.
WINDOW, TOGETHER = 2048, 1 << 16


def _bits(c: str) -> int:
    latin = c.isascii()
    return (
        DIGIT * (latin and c.isdigit()) | LETTER * (latin and c.isalpha()) | ALPHA * c.isalpha() | ALNUM * c.isalnum() | SPACE * c.isspace()
        | IN_LOCAL * (c in LOCAL) | IN_DOMAIN * (latin and (c.isalnum() or c == "-"))
    )


class Tokens:
    """The islands of ``texts`` as one array of tokens: runs of digits, runs of letters, single others.

    Token ``t`` of island ``k`` (``first[k] <= t < last[k]``) begins at ``place(t)`` of its text.
    """

    def __init__(self, texts: list[str]) -> None:
        found = [(n, a, b) for n, t in enumerate(texts) for a, b in islands(t)]
        joined = "\n" + "".join(texts[n][a:b] + "\n" for n, a, b in found)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bits = np.array([_bits(chr(c)) for c in range(128)], np.uint8)[np.minimum(code, 127)]
        for c in np.unique(code[code > 127]).tolist():
            self.bits[code == c] = _bits(chr(c))
        lengths = np.array([b - a for _, a, b in found], np.int64)
        begin = np.cumsum(lengths + 1) - lengths  # of each island, after the separator before it
        self.code = code.astype(np.int32)
        self.code[0] = self.code[begin + lengths] = -1  # separators are of no text
        kind = self.bits & (DIGIT | LETTER)
        self.cuts = np.append(np.flatnonzero((kind == 0) | np.append(True, kind[1:] != kind[:-1])), len(code)).astype(np.int32)
        self.first = np.searchsorted(self.cuts, begin)
        self.last = np.searchsorted(self.cuts, begin + lengths)
        self.text = np.array([n for n, _, _ in found], np.int64)
        self.shift = np.array([a for _, a, _ in found], np.int64) - begin

    def island(self, token: int) -> int:
        return int(np.searchsorted(self.first, token, side="right")) - 1

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``i, j, x``: candidates from token ``i`` to before ``j`` by ``i, j``, and which features they have."""
        for low in range(0, len(self.cuts) - 1, WINDOW):
            yield self._window(low, min(len(self.cuts) - 1, low + WINDOW))

    def _window(self, low: int, high: int):
        stop = min(len(self.cuts) - 1, high + TOKENS)
        cuts = self.cuts[low : stop + 1].astype(np.int64)
        code, bits = self.code[cuts[:-1]], self.bits[cuts[:-1]]  # the first character of each token
        digit, letter = bits & DIGIT > 0, bits & LETTER > 0
        is_ = lambda c: code == ord(c)
        run = lambda mask: np.append(0, np.cumsum(mask, dtype=np.int64))  # noqa: E731  how many before each boundary
        dot, at = is_("."), is_("@")
        alone = code == -1
        evidence = run(digit | at)
        i = np.repeat(np.arange(high - low), TOKENS)
        j = i + np.tile(np.arange(1, TOKENS + 1), high - low)
        opens = ((bits & ALNUM > 0) | is_("+") | is_("(")) & ~alone
        ok = (j < len(cuts)) & opens[i]
        i, j = i[ok], j[ok]
        walls = run(alone)
        ok = (walls[j] == walls[i]) & (evidence[j] > evidence[i]) & (bits[j - 1] & ALNUM > 0)
        i, j = i[ok], j[ok]
        between = lambda mask: (c := run(mask))[j] - c[i]

        size = np.diff(cuts)
        digits = run(np.where(digit, size, 0))
        n = digits[j] - digits[i]
        letters = between(bits & ALPHA > 0) > 0
        dots, dash, bracket = between(dot), between(is_("-")) > 0, between(is_("(")) > 0
        x = np.zeros((len(i), len(NAMES)), bool)
        x[:, 0] = True
        # one @: what is before it in the span, and a domain after it
        a = np.minimum.accumulate(np.where(at, np.arange(len(code)), len(code) - 1)[::-1])[::-1][i]
        a = np.minimum(a, j - 1)
        foreign, odd = run(bits & IN_LOCAL == 0), run((bits & IN_DOMAIN == 0) & ~dot)
        twice, dot_count = run(dot & np.append(False, dot[:-1])), run(dot)
        after = np.minimum(a + 1, len(code) - 1)
        x[:, 1] = (
            (between(at) == 1) & (a > i) & (foreign[a] == foreign[i]) & (a + 1 < j) & ~dot[after]
            & (odd[j] == odd[after]) & (twice[j] == twice[after]) & (dot_count[j] > dot_count[after])
        )
        x[:, 2] = letters
        x[:, 3] = ~letters & (dots == 3) & (j - i == 7) & (between(digit) == 4)
        above = np.zeros(len(code), bool)
        for t in np.flatnonzero(digit & (size > 2)):
            above[t] = not _small("".join(map(chr, self.code[cuts[t] : cuts[t + 1]])) if size[t] < 64 else self._digits(cuts[t], cuts[t + 1]))
        x[:, 4] = x[:, 3] & (between(above) == 0)
        x[:, 5] = is_("+")[i]
        chars = slice(cuts[0], cuts[-1])
        d = (self.code[chars][self.bits[chars] & DIGIT > 0] - ord("0")).astype(np.int64)
        twofold = 2 * d - 9 * (d > 4)
        odd_place = np.arange(len(d)) % 2 == 1
        sums = np.stack([run(np.where(odd_place, twofold, d)), run(np.where(odd_place, d, twofold))])
        last = (digits[j] - 1) % 2  # digits in places of the last one's parity count as they are
        x[:, 6] = (n >= 16) & (n <= 19) & ~letters & ((sums[last, digits[j]] - sums[last, digits[i]]) % 10 == 0)
        x[np.arange(len(i)), 7 + np.searchsorted([0, 3, 7, 9, 11, 15, 19], n)] = True
        x[:, 15], x[:, 16], x[:, 17], x[:, 18] = bracket, dash, between(is_(" ")) > 0, dots > 0
        plain = np.isin(code, [ord(c) for c in "+()-. @"])
        x[:, 19] = between((bits & ALNUM == 0) & ~plain) > 0
        before, beyond = self.bits[cuts[i] - 1], self.bits[np.minimum(cuts[j], len(self.bits) - 1)]
        farther = self.bits[np.minimum(cuts[j] + 1, len(self.bits) - 1)]
        alnum = lambda b: b & ALNUM > 0
        sign = lambda b: b & (ALNUM | SPACE) == 0
        x[:, 20] = alnum(before) & alnum(bits[i])
        x[:, 21] = alnum(beyond)
        x[:, 22] = sign(before)
        x[:, 23] = digit[j - 1]
        x[:, 24] = j - i == 1
        x[:, 25] = (j - i > 1) & (j - i < 6)
        x[:, 26] = bracket & dash & ~letters
        x[:, 27] = sign(beyond) & alnum(farther)
        return i + low, j + low, x

    def _digits(self, a: int, b: int) -> str:
        return self.code[a:b].astype(np.uint8).tobytes().decode("ascii")


@dataclass
class Model:
    """``weights[kind][feature]``; a token outside of any span scores 0."""

    weights: list[list[float]]

    def segments(self, tokens: Tokens) -> list[tuple[int, int, int]]:
        """The best segmentation: ``(i, j, kind)`` in order.

        Rolls along the tokens: ``now`` is the best total up to a token, ``open_`` the best segment
        that ends at each of the next ``TOKENS`` boundaries, ``back`` what is needed to go back.
        """
        w = np.array(self.weights).T
        now, done = 0.0, 0
        open_: dict[int, tuple[float, int, int]] = {}
        back: dict[int, tuple[int, int]] = {}

        def close(to: int) -> None:
            nonlocal now
            for t in sorted(t for t in open_ if t <= to):
                value, i, k = open_.pop(t)
                if value > now:
                    now, back[t] = value, (i, k)

        for i, j, x in tokens.windows():
            score = x @ w
            kind = score.argmax(1)
            top = score[np.arange(len(kind)), kind]
            good = top > 0
            for a, b, s, k in zip(i[good].tolist(), j[good].tolist(), top[good].tolist(), kind[good].tolist()):
                if a > done:
                    close(a)
                    done = a
                if b not in open_ or now + s > open_[b][0]:
                    open_[b] = now + s, a, k
        close(len(tokens.cuts))
        out, at = [], None
        for j in sorted(back, reverse=True):
            if at is None or j <= at:
                at, k = back[j]
                out.append((at, j, k))
        return out[::-1]

    def decode_all(self, texts: list[str]) -> list[list[Span]]:
        """The spans of each text, by place. Islands are read together, but no span leaves its own."""
        tokens = Tokens(texts)
        out: list[list[Span]] = [[] for _ in texts]
        for i, j, k in self.segments(tokens):
            n = tokens.island(i)
            shift = int(tokens.shift[n])
            end = int(tokens.cuts[j])
            out[tokens.text[n]].append((KINDS[k], int(tokens.cuts[i]) + shift, end + shift))
        return out

    def decode(self, text: str) -> list[Span]:
        return self.decode_all([text])[0]


def without_overlaps(spans: list[Span], own: list[Span]) -> list[Span]:
    """``spans`` that none of ``own`` (of a kind: in order and apart) overlaps in their kind."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for k, a, b in own:
        ends.setdefault(k, []).append((a, b))

    def clear(s: Span) -> bool:
        of_kind = ends.get(s[0], [])
        at = bisect_left(of_kind, (s[2],))  # the last one that begins before the span's end
        return not at or of_kind[at - 1][1] <= s[1]

    return [s for s in spans if clear(s)]


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about ``TOGETHER`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def gold(text: str) -> list[Span]:
    """Base spans without overlaps: earlier kinds come first."""
    out: list[Span] = []
    for s in base(text):
        if not any(o[1] < s[2] and s[1] < o[2] for o in out):
            out.append(s)
    return out


def examples(text: str) -> list[str]:
    """The islands of a text as strings, with what stands beside them."""
    return [text[max(0, a - 1) : b + 1] for a, b in islands(text)]


def fit(texts: list[str], rounds: int = 150, rate: float = 0.2, ridge: float = 2e-3) -> Model | None:
    """Weights of greatest likelihood (less a ridge) of the base's spans in the islands of ``texts``."""
    variants: list[tuple[str, list[Span]]] = []
    for t in texts:
        own = gold(t)
        variants.append((t, own))
        for kind, a, b in own:
            if kind == "phone" and (m := re.match(r"\+[0-9]+[ .-]", t[a:b])):
                cut = a + m.end()
                shorter = t[:a] + t[cut:]
                if len(_digits(shorter[a : b - m.end()])) >= 8:
                    variants.append((shorter, [s for s in gold(shorter) if s[2] <= a or s[1] >= b - m.end()] + [("phone", a, b - m.end())]))
    tokens = Tokens([t for t, _ in variants])
    found = [np.concatenate(c) for c in zip(*tokens.windows())]
    if not found or not len(found[0]):
        return None
    starts, stops, x_all = found
    place = {}
    for n, (a, b) in enumerate(zip(tokens.first.tolist(), tokens.last.tolist())):
        place.update({(int(tokens.text[n]), int(tokens.cuts[t] + tokens.shift[n])): t for t in range(a, b + 1)})
    true = {(place[n, a], place[n, b]): KINDS.index(k) for n, (_, spans) in enumerate(variants) for k, a, b in spans if (n, a) in place and (n, b) in place}
    truth = np.array([true.get(s, -1) for s in zip(starts.tolist(), stops.tolist())])
    everything = x_all.astype(np.float64)
    edges = np.searchsorted(starts, tokens.first).tolist() + [len(starts)]
    data = [(int(e - s) + 1, list(zip((starts[a:b] - s).tolist(), (stops[a:b] - s).tolist()))) for s, e, a, b in zip(tokens.first, tokens.last, edges, edges[1:]) if a < b]
    w = np.zeros((len(KINDS), len(NAMES)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    observed = np.stack([everything[truth == k].sum(0) for k in range(len(KINDS))])
    for step in range(1, rounds + 1):
        scores = everything @ w.T
        expected = np.zeros_like(scores)
        offset = 0
        for length, spans in data:
            s = scores[offset : offset + len(spans)]
            total = np.logaddexp.reduce(s, axis=1).tolist()
            alpha, beta = [0.0] * length, [0.0] * length
            ends: list[list] = [[] for _ in range(length)]
            starts: list[list] = [[] for _ in range(length)]
            for (i, j), c in zip(spans, total):
                ends[j].append((i, c))
                starts[i].append((j, c))
            for j in range(1, length):
                alpha[j] = _logsum([alpha[j - 1], *(alpha[i] + c for i, c in ends[j])])
            for i in range(length - 2, -1, -1):
                beta[i] = _logsum([beta[i + 1], *(beta[j] + c for j, c in starts[i])])
            outside = np.array([alpha[i] + beta[j] for i, j in spans]) - alpha[-1]
            expected[offset : offset + len(spans)] = np.exp(np.minimum(0, outside[:, None] + s))
            offset += len(spans)
        g = (expected.T @ everything - observed) / len(data) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(w.tolist())


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(x - top) for x in values))


#: Islands that weights are learned from, at most, and the characters of the longest of them (longer ones
#: are decoded as any other, but teach nothing: so the sample is bounded in bytes).
ISLANDS, LONGEST = 800, 120


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``ISLANDS`` distinct islands of at most about ``sample`` documents, picked by hashes."""
    order = share_of_hash(F.col("doc_id"), "pii sample")
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    n = rows.count()

    def cut(batches):
        for b in pieces(batches):
            found = [[x for x in examples(t) if len(x) <= LONGEST] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.string())], ["island"])

    islands_ = rows.where(order < min(1.0, sample / max(1, n))).select("text").mapInArrow(cut, "island string").distinct()
    kept = islands_.orderBy(F.xxhash64("island"), "island").limit(ISLANDS).collect()
    return fit([r[0] for r in kept])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in pieces(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            own = [base(t) for t in texts]
            more = [d for g in grouped(texts) for d in m.decode_all(g)] if m else [[] for _ in texts]
            every = [sorted(o + without_overlaps(d, o), key=lambda s: (KINDS.index(s[0]), s[1], s[2])) for d, o in zip(more, own)]
            counts = [pa.array([sum(s[0] == k for s in o) for o in own], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(_joined(o).encode()).hexdigest() for o in own], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digests, pa.array(map(_joined, every), pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {''.join(f'n_{k} long, ' for k in KINDS)}base_sha256 string, spans string")
