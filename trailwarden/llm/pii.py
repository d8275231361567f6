"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what they miss.

Four patterns (e-mail, IP address, payment card, phone) give the base spans, leftmost and not
overlapping per kind; a match that fails its check (part over 255, Luhn, number of digits) is
dropped.  They are also the teacher: windows around their spans and around other numbers, at
most ``per_class`` of each kind (those of smallest text hash, so the same however the data is
partitioned), train a bidirectional LSTM with CRF transitions over B/I tags, written in numpy.
Spelled-out and differently separated forms of the same spans, and spans that run into another
number, join the training windows, so that the tagger learns the neighbours of the patterns.

Every place that could hold a span is tagged: all windows of 96 characters, 48 apart, that hold a
digit of any script, an at sign, or the word "at" in brackets or between white space.  No text
without one of these passes the check of any kind (``passes``), and an added span is at most 48
characters long, so it lies whole in one such window: tagging the other windows, too, gives the
same spans.  The Viterbi spans of all windows are brought to document positions, those cut by a
window edge are left to the next window, spans that fail the check of their kind are dropped,
and the best set without overlap is chosen over the whole document by weighted interval
scheduling.  Base spans always stay;
added ones never overlap them.

Defined results: a null or empty text has no spans; a null id is kept; repeated rows are each
searched; without any base span in the table there is nothing to learn from and nothing is
added; a text of any length is searched whole (all scans are linear, memory is a few times the
text); an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged, text_slices

KINDS = ("email", "ip", "card", "phone")
PER_CLASS = 320
WINDOW, STRIDE = 96, 48
HIDDEN, EMBED = 24, 16
SPAN_TYPE = "array<struct<kind:string,begin:long,end:long,base:boolean>>"

# ---- base patterns; each is scanned in linear time, with the matches of the plain pattern

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        run = text[max(end, text.rfind("@", end, at) + 1):at]
        begin = len(run.rstrip(_LOCAL)) - len(run) + at
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        at += 1
        if found:
            yield begin, found.end()
            end = at = found.end()


def _ips(text: str):
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str):
    for chain in _DIGITS.finditer(text):
        if 13 <= chain.end() - chain.start() <= 40:
            digits = chain.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield chain.span()


def _phones(text: str):
    for found in _PHONE.finditer(text):
        whole = found.group().rstrip(" ().-")
        if len(whole) >= 4 and 9 <= sum(map(str.isdigit, whole)) <= 15:
            yield found.start(), found.start() + len(whole)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) in code points, by kind and place."""
    if not _ANY.search(text):
        return []
    finders = (_emails, _ips, _cards, _phones)
    return [(k, a, b) for k, find in enumerate(finders) for a, b in find(text)]


# ---- checks of added spans, on their plain form

_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x2010: 45, 0x2011: 45, 0x2012: 45, 0x2013: 45, 0x2212: 45, 0xA0: 32, 0x3000: 32}
_AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*", re.I)
_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+", re.I)
_PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_PLAIN_IP = re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}")
_PLAIN_CARD = re.compile(r"[3-6][0-9]*+(?:[ ./_-]{1,2}[0-9]++)*+")
_PLAIN_PHONE = re.compile(r"(?:\+|00 ?[1-9]|\([0-9]{2,4}\))[0-9 ()./-]*[0-9]")


def plain(text: str) -> str:
    """ASCII digits and signs for those of other scripts; one character each."""
    folded = text.translate(_FOLD)
    if folded.isascii():
        return folded
    return "".join(str(int(c)) if c.isdecimal() else c for c in folded)


def passes(kind: int, text: str) -> bool:
    """Whether a span is one of its kind once it is written plainly."""
    text = plain(text)
    digits = "".join(c for c in text if c in "0123456789")
    if kind == 0:
        return bool(_PLAIN_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if kind == 1:
        text = _DOT.sub(".", text)
        return bool(_PLAIN_IP.fullmatch(text)) and all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return bool(_PLAIN_CARD.fullmatch(text)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(_PLAIN_PHONE.fullmatch(text)) and 9 <= len(digits) <= 15


# ---- windows

_OTHER, _LETTER, _PAD = 1, 2, 0
_CODES = np.full(0x3000, _OTHER, np.int16)
for _c in range(0x3000):
    _x = plain(chr(_c))
    _CODES[_c] = 3 + ord(_x) - 32 if 32 <= ord(_x) < 127 else 98 if _x in "\n\r\t" else _LETTER if _x.isalpha() else _OTHER
VOCABULARY = 99
_TRIGGER = re.compile(r"[\d@＠]|[\[({<]\s?at\s?[\])}>]", re.I)
# some match lies in every text that passes, also in other scripts' digits and in full-width signs
_NEEDED = re.compile(r"[\d@＠]|[\[({<［（｛＜]\s*[aａ][tｔ]\s*[\])}>］）｝＞]|\s[aａ][tｔ](?=\s)", re.I)


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    high = points >= 0x3000
    if not high.any():
        return _CODES[points]
    codes = np.where(high, _LETTER, _CODES[np.minimum(points, 0x2FFF)])
    for i in np.flatnonzero(high & (points >= 0xFF01) & (points < 0xFF5F)).tolist():
        codes[i] = _CODES[points[i] - 0xFEE0]
    for i in np.flatnonzero(high).tolist():
        if chr(points[i]).isdecimal():
            codes[i] = 3 + 16 + int(chr(points[i]))
    return codes


def window_starts(text: str) -> list[int]:
    """Begins of all windows that could hold a span; the others hold no text that passes a check."""
    found: dict[int, None] = {}
    for m in _NEEDED.finditer(text):
        k = m.start() // STRIDE
        if k:
            found[k - 1] = None
        found[k] = None
    return [k * STRIDE for k in found]


# ---- the tagger: two LSTMs, emissions, CRF

TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
_FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
for _t in range(2, TAGS, 2):
    _FORBIDDEN[:, _t] = -1e4
    _FORBIDDEN[[_t - 1, _t], _t] = 0
_NO_START = np.array([-1e4 if t and t % 2 == 0 else 0 for t in range(TAGS)], np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    """Weights: letters, input and recurrent weights of both directions, emissions, transitions."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int, hidden: int = HIDDEN, embed: int = EMBED) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[..., hidden:2 * hidden] = 1  # remember at first
        return cls({"letters": rng.standard_normal((VOCABULARY, embed)).astype(np.float32) * 0.5, "input": draw(2, embed, 4 * hidden),
                    "bias": bias, "recur": draw(2, hidden, 4 * hidden), "emit": draw(2 * hidden, TAGS),
                    "emit_bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)})

    def run(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Emissions (time, window, tag); the second direction reads the windows backwards."""
        w = self.weights
        n, length = codes.shape
        hidden = w["recur"].shape[1]
        driven = w["letters"] @ w["input"] + w["bias"]
        h = c = np.zeros((2, n, hidden), np.float32)
        states = np.empty((2, length, n, hidden), np.float32)
        for t in range(length):
            z = h @ w["recur"]
            z[0] += driven[0][codes[:, t]]
            z[1] += driven[1][codes[:, length - 1 - t]]
            gates, g = _sigmoid(z[..., :3 * hidden]), np.tanh(z[..., 3 * hidden:])
            i, f, o = np.split(gates, 3, axis=2)
            before = (h, c)
            c = f * c + i * g
            bent = np.tanh(c)
            h = o * bent
            states[:, t] = h
            if keep is not None:
                keep.append((i, f, o, g, bent, *before))
        return states[0] @ w["emit"][:hidden] + states[1, ::-1] @ w["emit"][hidden:] + w["emit_bias"]

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (window, time), and how much each place speaks for its tag against none."""
        emit = self.run(codes)
        move = self.weights["move"] + _FORBIDDEN
        length, n, _ = emit.shape
        back = np.empty((length, n, TAGS), np.int8)
        best = emit[0] + _NO_START
        for t in range(1, length):
            ways = best[:, :, None] + move
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + emit[t]
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        margin = np.take_along_axis(emit.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0] - emit[:, :, 0].T
        return tags, margin

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradient by every weight."""
        w, keep = self.weights, []
        emit = self.run(codes, keep)
        length, n, _ = emit.shape
        hidden = w["recur"].shape[1]
        move = w["move"] + _FORBIDDEN
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0] + _NO_START
        for t in range(1, length):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + move, 1) + emit[t]
        for t in range(length - 2, -1, -1):
            behind[t] = _log_sum(move + (emit[t + 1] + behind[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        at, one = tags.T, np.arange(n)
        gold = np.take_along_axis(emit, at[:, :, None], 2)[:, :, 0].sum(axis=0) + move[at[:-1], at[1:]].sum(axis=0)
        d_emit = np.exp(ahead + behind - total[:, None])
        pairs = np.exp(ahead[:-1, :, :, None] + move + (emit[1:] + behind[1:])[:, :, None, :] - total[:, None, None]).sum(axis=(0, 1))
        np.subtract.at(pairs, (at[:-1], at[1:]), 1)
        for t in range(length):
            d_emit[t, one, at[t]] -= 1
        d_emit /= n
        states = np.stack([k[2] * k[4] for k in keep], axis=1)  # output gates times bent cells
        both = np.concatenate([states[0], states[1, ::-1]], axis=2)
        flat = d_emit.reshape(-1, TAGS)
        grad = {"move": pairs / n, "emit": both.reshape(-1, 2 * hidden).T @ flat, "emit_bias": flat.sum(axis=0)}
        d_both = d_emit @ w["emit"].T
        d_states = np.stack([d_both[..., :hidden], d_both[::-1, :, hidden:]])
        dz = np.empty((2, length, n, 4 * hidden), np.float32)
        dh = dc = np.zeros((2, n, hidden), np.float32)
        turned = w["recur"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            i, f, o, g, bent, _, c = keep[t]
            dh = d_states[:, t] + dh
            dc = dh * o * (1 - bent * bent) + dc
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dh, dc = dz[:, t] @ turned, dc * f
        before = np.stack([k[5] for k in keep], axis=1)
        grad["recur"] = before.reshape(2, -1, hidden).transpose(0, 2, 1) @ dz.reshape(2, -1, 4 * hidden)
        driven = np.zeros((2, VOCABULARY, 4 * hidden), np.float32)
        for d, order in ((0, codes.T), (1, codes.T[::-1])):
            hot = np.zeros((VOCABULARY, order.size), np.float32)
            hot[order.ravel(), np.arange(order.size)] = 1
            driven[d] = hot @ dz[d].reshape(-1, 4 * hidden)
        grad["bias"] = driven.sum(axis=1, keepdims=True)
        grad["input"] = w["letters"].T @ driven
        grad["letters"] = (driven @ w["input"].transpose(0, 2, 1)).sum(axis=0)
        return float((total - gold).mean()), grad


def train(codes: np.ndarray, tags: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Tagger:
    """Adam over shuffled batches with a falling rate; the same windows give the same tagger."""
    tagger, rng = Tagger.new(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    s = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    steps, step = epochs * -(-len(codes) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for a in range(0, len(codes), batch):
            some = order[a:a + batch]
            _, grad = tagger.gradient(codes[some], tags[some])
            scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grad.values()))))
            step += 1
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                tagger.weights[k] = (tagger.weights[k] - now * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return tagger


# ---- learning from labelled windows

def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def labelled_windows(docs: DataFrame, per_class: int = PER_CLASS) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """(class, text, spans) of windows around base spans (classes 0-3) and other numbers (4).

    Every text is searched; each task gives its ``per_class`` windows of smallest hash per class,
    and the smallest of all are kept: a bounded sample that does not depend on partitions.
    """

    def run(batches):
        kept: list[list] = [[] for _ in range(len(KINDS) + 1)]
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text or not _TRIGGER.search(text):
                    continue
                spans = sorted((a, b, k) for k, a, b in base_spans(text))
                at, taken = [(a, k) for a, b, k in spans if b - a <= STRIDE], 0
                for m in re.finditer(r"\d+", text):
                    while taken < len(spans) and spans[taken][1] <= m.start():
                        taken += 1
                    if taken == len(spans) or spans[taken][0] > m.start():
                        at.append((m.start(), len(KINDS)))
                for begin, kind in at:
                    shift = _hash(text[begin:begin + STRIDE]) % STRIDE
                    a = max(0, begin - shift)
                    window = text[a:a + WINDOW]
                    entry = (-_hash(window), window)
                    heap = kept[kind]
                    if len(heap) == per_class and entry[0] <= heap[0][0]:
                        continue
                    inside = [(max(x, a) - a, min(y, a + WINDOW) - a, k) for x, y, k in spans if x < a + WINDOW and y > a]
                    if any(h[1] == window for h in heap if h[0] == entry[0]):
                        continue
                    (heapq.heappush if len(heap) < per_class else heapq.heappushpop)(heap, (entry[0], window, inside))
        rows = [(kind, -h, w, [f"{a},{b},{k}" for a, b, k in inside]) for kind, heap in enumerate(kept) for h, w, inside in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.string()))], ["kind", "h", "text", "spans"])

    found = id_text(docs).select("text").mapInArrow(run, "kind int, h long, text string, spans array<string>")
    found = staged(found.distinct(), "pii-windows")
    out = []
    for kind in range(len(KINDS) + 1):
        for row in found.where(F.col("kind") == kind).orderBy("h", "text").limit(per_class).collect():
            out.append((kind, row["text"], [tuple(map(int, s.split(","))) for s in row["spans"]]))
    return out


def rewritten(kind: int, span: str, rng: np.random.Generator) -> tuple[str, str]:
    """Another spelling of a span, and what runs into it."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    number = "".join(map(str, rng.integers(0, 10, int(rng.integers(2, 17)))))
    after = pick("", "", f" {number}", f"-{number[:6]}") if kind > 1 else ""
    if kind == 0:
        span = span.replace("@", pick(" (at) ", "(at)", "[at]", " [at] ", " @ ", "＠", " at "))
        if rng.random() < 0.6:
            head, sep, tail = span.rpartition(" " if " at " in span else span[span.find("@") if "@" in span else -1:][:1] or " ")
            dot = pick("[.]", "(dot)", " [dot] ", " dot ")
            span = head + sep + tail.replace(".", dot)
    elif kind == 1:
        span = span.replace(".", pick("[.]", "(.)", " . ", " [.] ", "[dot]"))
    elif kind == 2:
        digits = re.sub(r"\D", "", span)
        sep = pick("", " ", "-", ".", "/", "_", "  ")
        span = sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    else:
        digits = re.sub(r"[^\d ()-]", "", span).strip()
        span = pick(f"+{digits}", f"00{digits}", f"+{digits}".replace("-", "/"), f"+{digits}".replace("-", "–"),
                    "(" + digits.split("(", 1)[1] if "(" in digits else f"+{digits}")
    return span, after


def training_set(windows: list[tuple[int, str, list[tuple[int, int, int]]]], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of the windows, and of one rewritten form of each that holds a whole span."""
    rng = np.random.default_rng(seed)
    texts = [(text, spans) for _, text, spans in windows]
    for kind, text, spans in windows:
        whole = [s for s in spans if s[2] == kind and s[0] > 0 and s[1] < WINDOW]
        if not whole:
            continue
        a, b, _ = whole[0]
        span, after = rewritten(kind, text[a:b], rng)
        head, tail = text[:a][-int(rng.integers(8, STRIDE)):], after + text[b:]
        shift = len(head) + len(span) + len(after) - b
        moved = [(x - a + len(head), y - a + len(head), k) for x, y, k in spans if y <= a and x - a + len(head) >= 0]
        moved += [(len(head), len(head) + len(span), kind)] + [(x + shift, y + shift, k) for x, y, k in spans if x >= b]
        if len(head) + len(span) <= WINDOW:
            texts.append(((head + span + tail)[:WINDOW], moved))
    codes, tags = np.zeros((len(texts), WINDOW), np.int16), np.zeros((len(texts), WINDOW), np.int64)
    for i, (text, spans) in enumerate(texts):
        found = codes_of(text)[:WINDOW]
        codes[i, :len(found)] = found
        for a, b, k in spans:
            tags[i, a:min(b, WINDOW)] = 2 + 2 * k
            tags[i, a:a + 1] = 1 + 2 * k
    return codes, tags


def learn(docs: DataFrame, per_class: int = PER_CLASS) -> Tagger | None:
    """A tagger taught by the base spans of ``docs``; nothing if there are none."""
    windows = labelled_windows(docs, per_class)
    if all(kind == len(KINDS) for kind, _, _ in windows):
        return None
    return train(*training_set(windows))


# ---- search

def tagged_spans(tagger: Tagger, texts: list[str], batch: int = 512) -> list[list[tuple[float, int, int, int]]]:
    """(score, kind, begin, end) of the spans of all windows, per text, in its positions."""
    out: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    owner, start, rows = [], [], []

    def flush():
        codes = np.zeros((len(rows), WINDOW), np.int16)
        for i, r in enumerate(rows):
            codes[i, :len(r)] = r
        tags, margin = tagger.decode(codes)
        for i in np.flatnonzero(tags.any(axis=1)).tolist():
            row, length = tags[i].tolist(), len(rows[i])
            size = len(texts[owner[i]])
            t = 0
            while t < length:
                if not row[t]:
                    t += 1
                    continue
                kind, end = (row[t] - 1) // 2, t + 1
                while end < length and row[end] == 2 + 2 * kind:
                    end += 1
                a, b = start[i] + t, start[i] + end
                # of the longest spans some only touch the edge of both their windows
                if (t > 0 or a == 0) and (end < WINDOW or b == size or t == WINDOW - STRIDE):
                    out[owner[i]].append((float(margin[i, t:end].sum()), kind, a, b))
                t = end
        owner.clear(), start.clear(), rows.clear()

    for n, text in enumerate(texts):
        starts = window_starts(text)
        codes = codes_of(text) if starts else None
        for a in starts:
            owner.append(n), start.append(a), rows.append(codes[a:a + WINDOW])
            if len(rows) == batch:
                flush()
    if rows:
        flush()
    return out


def reconciled(text: str, found: list[tuple[float, int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The best set of valid spans without overlap, beside the base spans."""
    best: dict[tuple[int, int, int], float] = {}
    edges = sorted((a, b) for _, a, b in base)
    reach = np.maximum.accumulate([b for _, b in edges]).tolist() if edges else []
    for score, kind, a, b in found:
        span = text[a:b]
        a, b = a + len(span) - len(span.lstrip(" \n\t,;:.")), b - len(span) + len(span.rstrip(" \n\t,;:.(-"))
        if score <= 0 or b - a < 7 or b - a > STRIDE:
            continue
        near = text[max(0, a - 1):a] + text[b:b + 1]
        if any(c.isalnum() for c in near) or not passes(kind, text[a:b]):
            continue
        i = bisect_right(edges, (b - 1, len(text) + 1))  # base spans that begin before b
        if i and reach[i - 1] > a:
            continue
        best[kind, a, b] = max(score, best.get((kind, a, b), 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    value, take = [0.0], []
    for n, s in enumerate(spans):
        with_it = value[bisect_right(ends, s[1], 0, n)] + best[s]
        take.append(with_it > value[-1])
        value.append(max(with_it, value[-1]))
    chosen, n = [], len(spans)
    while n:
        if take[n - 1]:
            chosen.append(spans[n - 1])
            n = bisect_right(ends, spans[n - 1][1], 0, n - 1)
        else:
            n -= 1
    return chosen


def find(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` of every whole text: kind, code points begin and end (exclusive), whether of the base."""

    def run(batches):
        for batch in (b for whole in batches for b in text_slices(whole)):
            texts = batch.column("text").to_pylist()
            added = tagged_spans(tagger, texts) if tagger else [[] for _ in texts]
            rows = []
            for text, more in zip(texts, added):
                base = base_spans(text)
                spans = [(k, a, b, True) for k, a, b in base]
                if more:
                    spans = sorted(spans + [(k, a, b, False) for k, a, b in reconciled(text, more, base)])
                rows.append([{"kind": KINDS[k], "begin": a, "end": b, "base": own} for k, a, b, own in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPAN_TYPE}")


def redacted(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_spans`` with every span replaced by its kind in angle brackets."""
    def run(batches):
        for batch in (b for whole in batches for b in text_slices(whole)):
            texts, counts = [], []
            for text, more in zip(batch.column("text").to_pylist(), tagged_spans(tagger, batch.column("text").to_pylist()) if tagger else [[]] * batch.num_rows):
                base = base_spans(text)
                out, at, spans = [], 0, sorted((a, b, k) for k, a, b in base + reconciled(text, more, base))
                for a, b, k in spans:
                    if b > at:  # base spans of two kinds may overlap
                        out += [text[at:max(a, at)], f"<{KINDS[k]}>" if a >= at else ""]
                        at = b
                texts.append("".join(out) + text[at:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                                             ["doc_id", "text", "n_spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_spans long")


def digests(found: DataFrame) -> DataFrame:
    """Contract form: base counts per kind, digest of the base spans, all spans as text."""
    def listed(base_only: bool):
        spans = F.filter("spans", lambda s: s["base"]) if base_only else F.col("spans")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")

    def counted(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, KINDS), F.sha2(listed(True), 256).alias("base_sha256"), listed(False).alias("spans"))
