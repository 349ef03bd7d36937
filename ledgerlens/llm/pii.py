"""Personal data by fixed base rules and a semi-Markov conditional random field.

The field scores whole candidate segments (up to ``MAX_UNITS`` units) with features of the segment as a whole, and a dynamic
programme over segments chooses boundaries and types together. Its weights are fitted here, on lines made from templates
with a fixed seed, by conditional likelihood; the number of lines is a parameter and doesn't depend on the data.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import add_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "secret")
MAX_UNITS = 8

# -- base rules ----------------------------------------------------------------------------------------------------------------
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
DIGIT = re.compile(r"[0-9]")
# the look-behinds only skip starts inside a run of digits, from where no match is possible if there is none from its start
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind and then start; each kind leftmost and without overlaps, failing matches dropped."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            # the local part is the run of its letters before @, not reaching into the match before
            at = m.start()
            start = at - LOCAL_BACK.match(text[max(end, at - 256) : at][::-1]).end()
            while start > end and at - start >= 256 and LOCAL_BACK.fullmatch(text[start - 1]):
                start -= LOCAL_BACK.match(text[max(end, start - 4096) : start][::-1]).end()
            if start < at:
                out.append((0, start, m.end()))
                end = m.end()
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# -- candidate segments and their features -------------------------------------------------------------------------------------
UNIT = re.compile(r"""[^\s"'(),;:!?<>\[\]{}|=*#$&%]*[^\s"'(),;:!?<>\[\]{}|=*#$&%.]|\S""")
HOT = re.compile(r"[0-9@]")
PIECE = re.compile(r"\S+")
SECRET_CUES = frozenset("token secret password passwd pwd key apikey api_key api-key access_key auth bearer credential credentials".split())
PHONE_CUES = frozenset("tel phone call fax mobile cell telephone".split())
NUMBER_CUES = frozenset("card visa account iban ssn passport id no number credit".split())
EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(\.[0-9]+)+")
DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}")
AMOUNT = re.compile(r"[0-9]{1,3}(,[0-9]{3})*([.,][0-9]+)?|[0-9]+[.,][0-9]+")
HEX = re.compile(r"[0-9a-fA-F]{20,}")
PHONE_CHARS = re.compile(r"[+0-9 ().-]+")
N_FEATURES = 30


def features(text: str, units: list[tuple[int, int]], i: int, j: int, lower: list[str]) -> list[float]:
    """What is true of the segment from unit ``i`` to unit ``j`` as a whole, and of its surroundings."""
    start, end = units[i][0], units[j][1]
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, single = len(digits), i == j
    groups = len(re.findall(r"[0-9]+", s))
    plain = bool(re.fullmatch(r"[0-9]([ -]?[0-9])*", s))
    phone_chars = bool(PHONE_CHARS.fullmatch(s))
    dotted = bool(DOTTED.fullmatch(s))
    ip = dotted and s.count(".") == 3 and all(len(p) <= 3 and int(p) <= 255 for p in s.split("."))
    letters = any(c.isalpha() for c in s)
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    context = lower[max(0, i - 4) : i]
    secret = any(w in SECRET_CUES for w in context)
    mixed = single and letters and n > 0 and len(s) >= 8 and "@" not in s
    joined_before = i > 0 and text[units[i - 1][0] : units[i - 1][1]].isdigit() and start - units[i - 1][1] <= 1
    joined_after = j + 1 < len(units) and text[units[j + 1][0]].isdigit() and units[j + 1][0] - end <= 1
    sealed = (s[0].isalnum() or s[0] in "+(") and s[-1].isalnum() and s.count("(") == s.count(")")
    return [float(x) for x in (
        1, EMAIL_SHAPE.fullmatch(s) is not None, "@" in s, ip, dotted and not ip, plain and 13 <= n <= 19, plain and 13 <= n <= 19 and luhn(digits),
        phone_chars and 9 <= n <= 15, phone_chars and n in (10, 11), s[0] == "+", "(" in s and sealed, phone_chars and groups >= 3, n < 7, n in (7, 8),
        HEX.fullmatch(s) is not None and letters and n > 0, mixed, single, j - i >= 3, secret, secret and before in ("'", '"', "=", ":", " ") and single and n > 0,
        any(w in PHONE_CUES for w in context), any(w in NUMBER_CUES for w in context), DATE.fullmatch(s) is not None, AMOUNT.fullmatch(s) is not None,
        before.isalnum() or after.isalnum() or before in ("@", "_"), not sealed, joined_before or joined_after, single and plain and n >= 9,
        before in ("'", '"') and after in ("'", '"'), n == 0,
    )]


def segments(text: str, units: list[tuple[int, int]], first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    """Candidates that end at units ``first`` to ``last``: up to ``MAX_UNITS`` units, each at most two characters from the next, of
    which the last holds a digit or an @ and the first does too or opens with + or a bracket."""
    last = len(units) if last is None else last
    low = max(0, first - MAX_UNITS + 1)
    hot = [HOT.search(text, *u) is not None for u in units[low:last]]
    out = []
    for j in range(first, last):
        if not hot[j - low]:
            continue
        for i in range(j, max(-1, j - MAX_UNITS), -1):
            if hot[i - low] or text[units[i][0]] in "+(":
                out.append((i, j))
            if i and units[i][0] - units[i - 1][1] > 2:
                break
    return sorted(out)


# -- the field -----------------------------------------------------------------------------------------------------------------
class Field:
    """Weights of segment features by kind, and of neighbouring labels; label 0 is a single unit outside."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, text: str, start: int, end: int, block: int = 1024) -> list[Span]:
        """The best segmentation of ``text[start:end]``, as (kind, start, end).

        Units are read in blocks. After a block, all segmentations that can still win are followed back to the place that they share;
        what lies before it is final and forgotten, so memory doesn't grow with the text.
        """
        labels, out = len(KINDS) + 1, []
        found = (m.span() for m in UNIT.finditer(text, start, end))
        units: list[tuple[int, int]] = []
        best, back = [np.full(labels, -np.inf)], [np.zeros((labels, 2), int)]  # of each place between units; ``back``: place and label
        best[0][0] = 0.0
        done, more = 0, True
        while more or done < len(units):
            units += islice(found, block + 1 + done - len(units) if more else 0)
            more = len(units) > done + block
            upto = min(len(units), done + block) if more else len(units)
            self._forward(text, units, done, upto, best, back)
            done = upto
            if not more:
                break
            place, label = self._shared(best, back, done)
            out += self._trace(units, back, place, label)
            # context reaches four units back, and the next block's segments MAX_UNITS
            drop = max(0, min(place, done - MAX_UNITS - 4))
            if drop:
                del units[:drop], best[:drop], back[:drop]
                place, done = place - drop, done - drop
                for row in back:
                    row[:, 0] -= drop
            back[place][label] = (-1, 0)  # final up to here
        out += self._trace(units, back, done, int(best[done].argmax()))
        return out

    def _forward(self, text: str, units: list[tuple[int, int]], first: int, last: int, best: list, back: list) -> None:
        """Best scores of the places after units ``first`` to ``last``."""
        found = segments(text, units, first, last)
        low = max(0, first - MAX_UNITS - 4)
        lower = [""] * low + [text[a:b].lower() for a, b in units[low:]]
        scores = np.array([features(text, units, i, j, lower) for i, j in found]).reshape(len(found), N_FEATURES) @ self.weights
        ending: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (i, j), s in zip(found, scores):
            ending.setdefault(j, []).append((i, s))
        labels = len(KINDS) + 1
        for t in range(first + 1, last + 1):
            now, from_ = np.full(labels, -np.inf), np.zeros((labels, 2), int)
            come = best[t - 1] + self.moves[:, 0]
            k = int(come.argmax())
            now[0], from_[0] = come[k], (t - 1, k)
            for i, s in ending.get(t - 1, ()):
                come = best[i][:, None] + self.moves[:, 1:]
                k = come.argmax(axis=0)
                total = come[k, np.arange(labels - 1)] + s
                better = total > now[1:]
                now[1:][better] = total[better]
                from_[1:, 0][better], from_[1:, 1][better] = i, k[better]
            best.append(now)
            back.append(from_)

    def _shared(self, best: list, back: list, done: int) -> tuple[int, int]:
        """The last place and label through which every segmentation goes that can still win."""
        ahead = {(t, y) for t in range(max(0, done - MAX_UNITS + 1), done + 1) for y in range(len(KINDS) + 1) if np.isfinite(best[t][y])}
        while len(ahead) > 1:
            last = max(ahead)
            ahead.remove(last)
            before = tuple(back[last[0]][last[1]].tolist())
            if before[0] < 0:
                return last
            ahead.add(before)
        return ahead.pop()

    def _trace(self, units: list[tuple[int, int]], back: list, place: int, label: int) -> list[Span]:
        out = []
        while place > 0:
            before, earlier = back[place][label]
            if before < 0:
                break
            if label:
                out.append((label - 1, units[before][0], units[place - 1][1]))
            place, label = int(before), int(earlier)
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        """Decodes around digits and @ only, with all the units on each side that a segment or its context can reach: elsewhere no
        segment is possible, and units outside add nothing to the score."""
        pieces = np.array([m.span() for m in PIECE.finditer(text)], np.int64).reshape(-1, 2)  # of one unit at least
        at = np.searchsorted(pieces[:, 0], [m.start() for m in HOT.finditer(text)], "right") - 1
        at = np.unique(at)
        reach = MAX_UNITS + 5
        cut = np.flatnonzero(np.diff(at) > 2 * reach)
        out = []
        for a, b in zip(np.concatenate([at[:1], at[cut + 1]]).tolist(), np.concatenate([at[cut], at[-1:]]).tolist()):
            out += self.decode(text, int(pieces[max(0, a - reach)][0]), int(pieces[min(len(pieces) - 1, b + reach)][1]))
        return out


def _syllables(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ba de ki lo mu ne ra si to vu an er on st".split()) for _ in range(n))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, n: int) -> str:
    body = _digits(rng, n - 1)
    return next(body + c for c in "0123456789" if luhn(body + c))


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Lines of invented words with one or two entities, or with numbers that are none, and the right spans."""
    rng, out = random.Random(seed), []
    word = lambda: _syllables(rng, rng.randint(1, 4))
    hexed = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    code = lambda k: "a1" + "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(k))
    byte = lambda: str(rng.randint(0, 255))
    grouped = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    made = [
        lambda: ("", f"{word()}.{_digits(rng, 2)}@{word()}{_digits(rng, 1)}.example.com", "", 0), lambda: ("", f"{word()}@{word()}.org", "", 0),
        lambda: ("", f"{word()}_{word()}+{word()}@{word()}.co.uk", "", 0), lambda: ("", ".".join(byte() for _ in range(4)), "", 1),
        lambda: ("", _card(rng, 16), "", 2), lambda: ("", grouped(_card(rng, 16), rng.choice(" -")), "", 2), lambda: ("card ", _card(rng, 15), "", 2),
        lambda: ("", f"+{rng.randint(1, 9)} ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", "", 3),
        lambda: ("", f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", "", 3), lambda: ("", f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}", "", 3),
        lambda: ("", f"+{rng.randint(20, 99)} {_digits(rng, 2)} {_digits(rng, 4)} {_digits(rng, 4)}", "", 3), lambda: ("tel: ", f"0{_digits(rng, 3)} {_digits(rng, 7)}", "", 3),
        lambda: ("", _digits(rng, 16), "", 4), lambda: ("account ", _digits(rng, rng.randint(9, 14)), "", 4), lambda: ("", grouped(_digits(rng, 16), "-"), "", 4),
        lambda: ('token = "', hexed(40), '"', 5), lambda: ("api_key = '", code(18), "'", 5), lambda: ("password: ", code(10), "", 5), lambda: ("", hexed(40), "", 5),
        lambda: ("secret=", code(24), "", 5),
    ]
    none = [
        lambda: str(rng.randint(1, 2100)), lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}", lambda: f"${rng.randint(1, 999)},{_digits(rng, 3)}.{_digits(rng, 2)}",
        lambda: f"{rng.randint(10, 99)},{_digits(rng, 3)}", lambda: f"@{word()}", lambda: f"{word()}@{word()}", lambda: f"{rng.randint(256, 999)}.{byte()}.{byte()}.{byte()}",
        lambda: f"#{hexed(6)}", lambda: f"{word()}{rng.randint(1, 99)}", lambda: f"{_digits(rng, 3)} {_digits(rng, 3)}", lambda: f"{rng.randint(1, 99)}%", lambda: f"pages {rng.randint(1, 99)}-{rng.randint(100, 199)}",
        lambda: f"key {rng.randint(1, 99)}", lambda: f"{word()}-{_digits(rng, 4)}", lambda: f"({rng.randint(1900, 2030)})",
    ]
    for k in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 2)):
            text += "".join(word() + rng.choice([" ", " ", " ", ", ", ". "]) for _ in range(rng.randint(1, 3)))
            if rng.random() < 0.6:
                lead, body, tail, kind = rng.choice(made)()
                spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(body)))
                text += lead + body + tail
            else:
                text += rng.choice(none)()
            text += rng.choice([" ", ". ", ", ", "*** "])
        out.append((text + word() + ".", spans))
    return out


def _gather(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def fit(n: int = 400, seed: int = 5, steps: int = 120, rate: float = 0.15, shrink: float = 0.02) -> Field:
    """Maximise the conditional likelihood of ``n`` lines, all at once, by forward and backward passes and Adam."""
    lines = []
    for text, spans in examples(n, seed):
        units = [m.span() for m in UNIT.finditer(text)]
        lower = [text[a:b].lower() for a, b in units]
        cand = segments(text, units)
        gold = {(a, b): k for k, a, b in spans}
        lines.append((len(units), [(i, j, features(text, units, i, j, lower), gold.get((units[i][0], units[j][1]), -1)) for i, j in cand]))
    size, labels = max(u for u, _ in lines), len(KINDS) + 1
    feats = np.zeros((size + 1, MAX_UNITS + 1, n, N_FEATURES))
    allowed = np.full((size + 1, MAX_UNITS + 1, n), -np.inf)
    seen_w, seen_m = np.zeros((N_FEATURES, labels - 1)), np.zeros((labels, labels))
    for b, (_, cand) in enumerate(lines):
        truth = {}
        for i, j, f, kind in cand:
            feats[j + 1, j - i + 1, b], allowed[j + 1, j - i + 1, b] = f, 0.0
            if kind >= 0:
                seen_w[:, kind] += f
                truth[i] = (j + 1, kind + 1)
        t, y = 0, 0
        while t < lines[b][0]:
            t, now = truth.get(t, (t + 1, 0))
            seen_m[y, now] += 1
            y = now
    lengths, rows = np.array([u for u, _ in lines]), np.arange(n)
    w, moves = np.zeros((N_FEATURES, labels - 1)), np.zeros((labels, labels))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        scores = feats @ w + allowed[..., None]
        alpha = np.full((size + 1, n, labels), -np.inf)
        alpha[0, :, 0] = 0.0
        into = np.full((size + 1, n, labels), -np.inf)  # summed over the label before
        into[0] = _gather(alpha[0][:, :, None] + moves, 1)
        for t in range(1, size + 1):
            alpha[t, :, 0] = into[t - 1][:, 0]
            spans = np.stack([into[t - k][:, 1:] + scores[t, k] for k in range(1, min(t, MAX_UNITS) + 1)])
            alpha[t, :, 1:] = _gather(spans, 0)
            into[t] = _gather(alpha[t][:, :, None] + moves, 1)
        total = _gather(alpha[lengths, rows], 1)
        beta = np.full((size + 1, n, labels), -np.inf)
        beta[lengths, rows] = 0.0
        grad_w, grad_m = seen_w - shrink * w * n / 10, seen_m - shrink * moves * n / 10
        for t in range(size - 1, -1, -1):
            # what can start at t: one unit outside, or a segment
            out = np.full((n, labels), -np.inf)
            out[:, 0] = beta[t + 1][:, 0]
            most = min(MAX_UNITS, size - t)
            ahead = np.stack([scores[t + k, k] + beta[t + k][:, 1:] for k in range(1, most + 1)])
            out[:, 1:] = _gather(ahead, 0)
            live = t < lengths
            beta[t][live] = _gather(moves[None] + out[:, None, :], 2)[live]
            with np.errstate(invalid="ignore"):
                grad_m -= np.nansum(np.exp(alpha[t][:, :, None] + moves + out[:, None, :] - total[:, None, None])[live], axis=0)
                chance = np.exp(into[t][None, :, 1:] + ahead - total[None, :, None])
            chance = np.nan_to_num(chance) * live[None, :, None]
            for k in range(1, most + 1):
                grad_w -= feats[t + k, k].T @ chance[k - 1]
        for value, grad, m, v in ((w, grad_w / n, state[0], state[1]), (moves, grad_m / n, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        moves[0, 0] = 0.0
    return Field(w, moves)


@lru_cache(1)
def _field(n: int, seed: int) -> Field:
    return fit(n, seed)


def personal_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: the base ones and the field's that don't touch them; both by kind and start."""
    text = text or ""
    base = base_spans(text)
    if not HOT.search(text):
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    added = []
    for kind, a, b in field.spans(text):
        at = int(np.searchsorted(starts, b, side="left"))
        if at == 0 or reach[at - 1] <= a:
            added.append((kind, a, b))
    return base, sorted(base + added)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, examples: int = 400, seed: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans`` of every row: a map without a shuffle.

    The counts are of base spans. Spans are ``kind:start:end`` in code points, end exclusive, by kind (base kinds first, then
    number and secret) and start, comma-joined. A null or empty text has none; repeated rows come out once each; other
    columns are not read. The field is fitted once on the driver and travels with the task: a few hundred weights.
    """
    field = _field(examples, seed)

    def of(texts: list[str | None]) -> list:
        found = [personal_spans(t, field) for t in texts]
        counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in range(len(BASE))]
        return [*counts, [_written(base) for base, _ in found], [_written(all_) for _, all_ in found]]

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [*[(f"n_{k}", "long") for k in BASE], ("base_spans", "string"), ("spans", "string")]
    return add_columns(rows, "text", of, fields).drop("text")
