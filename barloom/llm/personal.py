"""Personal data by base rules and a semi-Markov conditional random field.

Base rules find e-mail addresses, IP addresses, card and phone numbers in their usual forms. The field adds what is written
otherwise ("jane at mail dot com", "(017) 555-7713", "10[.]0[.]0[.]7"), or stands so near to other numbers that base rules drop both: it scores whole candidate spans of up to `LONGEST`
tokens by what they hold as a whole (digits, groups of digits, dots, brackets, ends, neighbours), for each type, and a dynamic
program picks the segmentation of the text with the greatest sum, so that boundaries and types are chosen together. A token
outside of spans counts 0. A span is kept if its score is at least `cutoff`; spans that touch a base span give way to it.

The field is trained by the likelihood of labelled segmentations: texts in which base rules find something, those texts with
what was found written in other ways (`VARIANTS`), and texts with dates, versions, amounts and the like (`DECOYS`), which are
no personal data; made-up entities stand in some, since few corpora hold each form, alone or two beside each other, which
base rules often take for one and drop. Texts come from about `sample` different ones of each kind, those whose hashes lie in a share of all hashes
that follows from the number of different texts, so that training is bounded however large the input is. The scan itself reads
every whole text.

Positions are code points. A null text counts as empty: no spans. Repeated rows are kept, equal texts get equal spans, and
further columns are ignored by the report; redacted() keeps them, and adds nothing. Without labelled texts there is no field,
only base rules.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import free_name, freeing, share_of_hashes, small_batches

#: Kinds in the order in which they are listed, and the patterns of the base rules.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens of the longest candidate, characters of context on either side of a hint, tokens scored at a time.
LONGEST, CONTEXT, BLOCK = 24, 100, 4096
HINT = re.compile(r"[0-9]+|@|\b(?:at|AT)\b(?=[\])}>\s]{1,3}[\w-]{1,40}[\s\[({<]{0,3}(?:(?:dot|DOT)\b|\.\w))")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W0-9_A-Za-z]+|\S")
LETTERS, DIGITS, AT, DOT, AT_WORD, DOT_WORD, PLUS, OPEN, CLOSE, DASH, BRACKET, OTHER, NONE = range(13)
MARKS = {"@": AT, ".": DOT, "+": PLUS, "(": OPEN, ")": CLOSE, "-": DASH, "[": BRACKET, "]": BRACKET, "{": BRACKET, "}": BRACKET, "<": BRACKET, ">": BRACKET}
#: Spaces that part two windows of tokens.
APART = 99


def luhn(digits: str) -> bool:
    twice = [2 * int(d) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of an address, leftmost first; what stands before an @ is looked up from there, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_END.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base rules find, by position."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    short = lambda part: len(part := part.lstrip("0")) < 4 and int(part or 0) <= 255
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(short, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


class Tokens:
    """Tokens of the windows around the hints of several texts, one after the other."""

    def __init__(self, texts: list[str]):
        starts, ends, owners, kinds, gaps = [], [], [], [], []
        for i, text in enumerate(texts):
            for a, b in _windows(text):
                last = None
                for m in TOKEN.finditer(text, a, b):
                    word = m[0]
                    gap = APART if last is None else m.start() - last
                    gaps.append(APART if gap > 2 or (gap and "\n" in text[last : m.start()]) else gap)
                    starts.append(m.start())
                    last = m.end()
                    ends.append(last)
                    owners.append(i)
                    kinds.append(DIGITS if "0" <= word[0] <= "9" else MARKS.get(word) or (AT_WORD if word in ("at", "AT") else DOT_WORD if word in ("dot", "DOT") else LETTERS if word[0].isalpha() else OTHER))
        self.start, self.end, self.owner, self.kind, self.gap = (np.array(x, np.int64) for x in (starts, ends, owners, kinds, gaps))
        self.length = self.end - self.start
        self.texts = texts
        self.sums = {}
        k = self.kind
        counted = {"digits": self.length * (k == DIGITS), "runs": k == DIGITS, "at": k == AT, "dots": k == DOT, "at_words": k == AT_WORD, "dot_words": k == DOT_WORD, "letters": k == LETTERS, "open": k == OPEN, "close": k == CLOSE, "dashes": k == DASH, "brackets": k == BRACKET, "other": k == OTHER, "plus": k == PLUS, "spaces": self.gap > 0, "breaks": self.gap >= APART}
        for name, values in counted.items():
            self.sums[name] = np.concatenate([[0], np.cumsum(values)])

    def __len__(self) -> int:
        return len(self.start)


def _windows(text: str):
    """Stretches of a text around its hints, apart from each other, that begin and end beside white space where they can."""
    begun = end = None
    for m in HINT.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if end is not None and a <= end:
            end = max(end, b)
            continue
        if end is not None:
            yield _trimmed(text, begun, end)
        begun, end = a, b
    if end is not None:
        yield _trimmed(text, begun, end)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The stretch without the words that its ends cut, if these lie in what surrounds the hints."""
    if a and not text[a - 1].isspace():
        first = re.compile(r"\s").search(text, a, min(b, a + CONTEXT))
        a = first.end() if first else a
    if b < len(text) and not text[b].isspace():
        last = max((i for i in range(max(a, b - CONTEXT), b) if text[i].isspace()), default=b)
        b = last
    return a, b


#: What is asked of a candidate, with the number of answers: counts beyond the last answer count as it.
ASKED = {"tokens": LONGEST + 1, "digits": 24, "runs": 9, "at": 3, "dots": 8, "at_words": 3, "dot_words": 5, "letters": 10, "parens": 4, "dashes": 6, "brackets": 7, "other": 3, "plus": 3, "spaces": 10, "first": 13, "last": 13, "before": 26, "after": 26, "longest": 21, "shortest": 21, "luhn": 3, "byte": 2, "digits_runs": 24 * 9, "runs_dots": 9 * 8, "first_last": 13 * 13}
OFFSETS = dict(zip(ASKED, np.concatenate([[0], np.cumsum(list(ASKED.values()))])[:-1].tolist(), strict=True))
SIZE = sum(ASKED.values())


def candidates(tokens: Tokens, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, last token (exclusive) and answers (as places in the weights) of the candidates that end in tokens lo to hi."""
    s, kind, length = tokens.sums, tokens.kind, tokens.length
    first, last, answers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, len(ASKED)), np.int32)]
    ends = np.arange(lo + 1, hi + 1)
    longest, shortest = np.zeros(len(ends), np.int64), np.full(len(ends), 20)
    high = np.zeros(len(ends), bool)  # a run of digits above 255
    value = np.array([int(tokens.texts[o][a : min(b, a + 4)]) if k == DIGITS else 0 for o, a, b, k in zip(tokens.owner[max(0, lo - LONGEST) : hi], tokens.start[max(0, lo - LONGEST) : hi], tokens.end[max(0, lo - LONGEST) : hi], kind[max(0, lo - LONGEST) : hi], strict=True)])
    shift = max(0, lo - LONGEST)
    for n in range(1, LONGEST + 1):
        live = ends >= n
        live[live] = s["breaks"][ends[live]] - s["breaks"][ends[live] - n + 1] == 0  # the gap before the first token doesn't count
        ends, longest, shortest, high = ends[live], longest[live], shortest[live], high[live]
        if not len(ends):
            break
        i = ends - n
        run = kind[i] == DIGITS
        longest = np.where(run, np.maximum(longest, np.minimum(length[i], 20)), longest)
        shortest = np.where(run, np.minimum(shortest, length[i]), shortest)
        high = high | (run & ((value[i - shift] > 255) | (length[i] > 3)))
        count = lambda name, i=i, ends=ends: s[name][ends] - s[name][i]
        a, z = kind[i], kind[ends - 1]
        fits = np.isin(a, (LETTERS, DIGITS, PLUS, OPEN)) & np.isin(z, (LETTERS, DIGITS))
        fits &= (count("at") + count("at_words") > 0) | (count("digits") >= 4)
        if not fits.any():
            continue
        i, e = i[fits], ends[fits]
        count = lambda name, i=i, e=e: s[name][e] - s[name][i]
        has = {name: count(name) for name in ("digits", "runs", "at", "dots", "at_words", "dot_words", "letters", "dashes", "brackets", "other", "plus")}
        has["tokens"] = e - i
        has["spaces"] = s["spaces"][e] - s["spaces"][i + 1]
        has["parens"] = np.where(count("open") == count("close"), np.minimum(count("open"), 1), 2 + (count("open") > count("close")))
        has["first"], has["last"] = kind[i], kind[e - 1]
        has["before"] = np.where(tokens.gap[i] >= APART, 2 * NONE, 2 * kind[i - 1] + (tokens.gap[i] == 0))
        beyond = np.minimum(e, len(tokens) - 1)
        has["after"] = np.where((e == len(tokens)) | (tokens.gap[beyond] >= APART), 2 * NONE, 2 * kind[beyond] + (tokens.gap[beyond] == 0))
        has["longest"], has["shortest"], has["byte"] = longest[fits], shortest[fits], (~high[fits]).astype(int)
        has["luhn"] = np.zeros(len(i), np.int64)
        for c in np.flatnonzero((has["digits"] >= 14) & (has["digits"] <= 19) & (has["letters"] == 0)):
            digits = "".join(ch for ch in tokens.texts[tokens.owner[i[c]]][tokens.start[i[c]] : tokens.end[e[c] - 1]] if "0" <= ch <= "9")
            has["luhn"][c] = 1 + luhn(digits)
        cut = {name: np.minimum(v, ASKED[name] - 1) for name, v in has.items()}
        cut["digits_runs"] = cut["digits"] * ASKED["runs"] + cut["runs"]
        cut["runs_dots"] = cut["runs"] * ASKED["dots"] + cut["dots"]
        cut["first_last"] = cut["first"] * 13 + cut["last"]
        first.append(i)
        last.append(e)
        answers.append(np.stack([cut[name] + OFFSETS[name] for name in ASKED], 1).astype(np.int32))
    return np.concatenate(first), np.concatenate(last), np.concatenate(answers)


def scores(answers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Candidates x types."""
    out = np.zeros((len(answers), len(KINDS)))
    for c in range(answers.shape[1]):
        out += weights[answers[:, c]]
    return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over axis 1, -inf where there is none."""
    top = np.maximum(x.max(1), -1e300)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top[:, None]).sum(1))


def best_segmentation(first: np.ndarray, last: np.ndarray, score: np.ndarray) -> list[int]:
    """The candidates of the segmentation with the greatest sum of scores; tokens outside count 0.

    A candidate that scores 0 or less is never better than its tokens outside, so that only the others are gone over, by the
    token at which they end. Of equal sums, the one whose last span ends first, and then begins first, is taken.
    """
    good = np.flatnonzero(score > 0)
    order = good[np.lexsort((first[good], last[good]))]
    ends, sums, back = [0], [0.0], [None]  # best sums over tokens up to these ends
    for c in order.tolist():
        before = bisect_right(ends, first[c]) - 1
        total = sums[before] + score[c]
        if total > sums[-1]:
            if ends[-1] == last[c]:
                sums[-1], back[-1] = total, (c, before)
            else:
                ends.append(int(last[c]))
                sums.append(total)
                back.append((c, before))
    out, k = [], len(ends) - 1
    while back[k] is not None:
        out.append(back[k][0])
        k = back[k][1]
    return out[::-1]


def added_spans(texts: list[str], base: list[list], weights: np.ndarray, cutoff: float) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the field finds in each text beside its base spans."""
    tokens = Tokens(texts)
    out: list[list] = [[] for _ in texts]
    found = []
    for lo in range(0, len(tokens), BLOCK):
        first, last, answers = candidates(tokens, lo, min(lo + BLOCK, len(tokens)))
        s = scores(answers, weights)
        kind = s.argmax(1) if len(s) else np.zeros(0, np.int64)
        s = s.max(1) if len(s) else np.zeros(0)
        good = s >= max(cutoff, 1e-9)
        found.append((first[good], last[good], kind[good], s[good]))
    if not found:
        return out
    first, last, kind, s = (np.concatenate(x) for x in zip(*found, strict=True))
    free = np.ones(len(first), bool)
    for c in range(len(first)):
        spans = base[tokens.owner[first[c]]]
        if spans:
            a, b = tokens.start[first[c]], tokens.end[last[c] - 1]
            free[c] = not any(x < b and a < y for x, _, y in spans)
    first, last, kind, s = first[free], last[free], kind[free], s[free]
    for c in best_segmentation(first, last, s):
        out[tokens.owner[first[c]]].append((int(tokens.start[first[c]]), int(kind[c]), int(tokens.end[last[c] - 1])))
    return out


#: Other ways to write what a base rule found: by kind, replacements that are made one after the other.
VARIANTS = {
    "email": [[("@", " at "), (".", " dot ")], [("@", " [at] "), (".", " [dot] ")], [("@", "(at)"), (".", "(dot)")], [("@", "[@]")], [("@", " @ ")], [("@", " at ")], [("@", "@"), (".", " . ")]],
    "ip": [[(".", "[.]")], [(".", "(.)")], [(".", " . ")], [(".", " dot ")]],
    "card": [[("", ".")], [("", " - ")], [("", "  ")]],
    "phone": [[("+", "")], [("+", "00")], [("+", ""), (" ", "-")], [("+", ""), (" ", ".")], [("+1 ", "")], [("+", "("), (" ", ") ")], [("+", "+ ")]],
}


def _varied(kind: str, text: str, rng: random.Random) -> str:
    made = rng.choice(VARIANTS[kind])
    if kind == "card":
        digits = re.sub("[^0-9]", "", text)
        return made[0][1].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    head, at, tail = text.partition("@")
    for old, new in made:
        if kind == "email" and old == ".":
            tail = tail.replace(old, new)
        elif kind == "email":
            at = at.replace(old, new)
        else:
            head = head.replace(old, new)
    return head + at + tail


def _made_up(rng: random.Random) -> tuple[str, str]:
    """Kind and text of an entity in one of its usual forms."""
    n = lambda a, b: rng.randint(a, b)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n(2, 9)))
    kind = rng.choice(KINDS)
    if kind == "email":
        name = rng.choice(["{0}", "{0}.{1}", "{0}_{1}", "{0}{2}", "{0}.{2}", "{0}-{1}"]).format(word(), word(), n(1, 99))
        return kind, f"{name}@" + rng.choice(["{0}", "{0}.{1}", "{0}{2}", "{0}-{1}"]).format(word(), word(), n(1, 9)) + rng.choice([".com", ".org", ".net", ".de", ".fr", ".es", ".co.uk"])
    if kind == "ip":
        return kind, ".".join(str(n(0, 255)) for _ in range(4))
    if kind == "card":
        digits = "".join(str(n(0, 9)) for _ in range(15))
        digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
        return kind, rng.choice(["", " ", "-"]).join(digits[i : i + 4] for i in range(0, 16, 4))
    area, a, b = n(100, 999), n(100, 999), n(1000, 9999)
    return kind, rng.choice([f"+1 ({area}) {a}-{b}", f"+1 {area} {a} {b}", f"+1-{area}-{a}-{b}", f"+{n(20, 99)} {n(1, 99)} {n(10**5, 10**8)}", f"+{n(20, 99)} {n(1, 999)} {n(100, 999)} {n(1000, 9999)}", f"+{n(20, 99)}{n(10**8, 10**9)}"])


def _decoy(rng: random.Random) -> str:
    """A date, time, version, amount, reference or the like, which is no personal data."""
    n = lambda a, b: rng.randint(a, b)
    made = [
        lambda: f"{n(1900, 2030)}-{n(1, 12):02}-{n(1, 28):02}", lambda: f"{n(1, 28):02}.{n(1, 12):02}.{n(1900, 2030)}", lambda: f"{n(1, 12)}/{n(1, 28)}/{n(1900, 2030)}", lambda: f"{n(1900, 2010)}-{n(2011, 2030)}",
        lambda: f"{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}", lambda: f"{n(1900, 2030)}-{n(1, 12):02}-{n(1, 28):02}T{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}Z", lambda: f"v{n(0, 20)}.{n(0, 40)}.{n(0, 40)}", lambda: f"{n(0, 20)}.{n(0, 40)}.{n(0, 4000)}",
        lambda: f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}", lambda: f"${n(1, 99999)}.{n(0, 99):02}", lambda: f"{n(1, 10**9)}", lambda: f"{n(10**11, 10**16)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(n(8, 64))),
        lambda: f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", lambda: f"pages {n(1, 400)}-{n(401, 999)}", lambda: f"at {n(1, 12)} pm", lambda: f"({n(1900, 2030)})", lambda: f"[{n(1, 99)}]", lambda: f"{n(1, 999)} x {n(1, 999)} x {n(1, 999)}", lambda: f"{n(-90, 90)}.{n(0, 99999):05}, {n(-180, 180)}.{n(0, 99999):05}",
        lambda: "at home. The", lambda: f"@{rng.choice(['home', 'media', 'import', 'user'])}{n(0, 99)}", lambda: f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)}", lambda: f"{n(10000, 99999)}-{n(1000, 9999)}",
    ]
    return rng.choice(made)()


def labelled(text: str, seed: int, most: int = 2) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Short texts with the spans that are in them, from a whole text: up to `most` of what the base rules find, drawn at
    random, each as it is and twice otherwise written, as many places with one or two that are made up, and as many decoys."""
    rng, out = random.Random(seed), []

    def around(a: int, b: int) -> tuple[str, str]:
        left, right = text[max(0, a - 60) : a], text[b : b + 60]
        return (left.partition(" ")[2] if a > 60 else left), (right.rpartition(" ")[0] if b + 60 < len(text) else right)

    def put(left: str, entities: list[tuple[int, str]], between: str, right: str) -> None:
        own, made = [x for x in base_spans(left) if x[2] < len(left)], left
        for n, (kind, entity) in enumerate(entities):
            made += between * (n > 0)
            own.append((len(made), kind, len(made) + len(entity)))
            made += entity
        out.append((made + right, own + [(a + len(made), k, b + len(made)) for a, k, b in base_spans(right) if a]))

    def made_up(usual: float) -> tuple[int, str]:
        kind, entity = _made_up(rng)
        return KINDS.index(kind), entity if rng.random() < usual else _varied(kind, entity, rng)

    spans = base_spans(text)
    for start, kind, end in rng.sample(spans, min(most, len(spans))):
        left, right = around(start, end)
        for entity in (text[start:end], *(_varied(KINDS[kind], text[start:end], rng) for _ in range(2))):
            put(left, [(kind, entity)], "", right)
    for n in range(most):
        left, right = around(*[rng.randrange(len(text) + 1)] * 2)
        put(f"{left} ", [made_up(0.3)] if n % 2 else [made_up(0.9), made_up(0.9)], rng.choice([" ", " ", " ", ", ", " / "]), f" {right}")
        short = f"{left} {_decoy(rng)} {right}"
        out.append((short, base_spans(short)))
    return [(short, own) for short, own in out if all(a[2] <= b[0] for a, b in zip(own, own[1:], strict=False))]


def fitted(rows: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 40, rate: float = 0.4, decay: float = 2e-3) -> np.ndarray:
    """Weights (answers x types) that make the labelled segmentations likely: gradient ascent on the field's log-likelihood.

    All texts are gone over at once: alpha[w, j] and beta[w, j] are the log-sums over the segmentations of the tokens of
    text w before and after j.
    """
    tokens = Tokens([text for text, _ in rows])
    weights = np.zeros((SIZE, len(KINDS)))
    if not len(tokens):
        return weights
    parts = [candidates(tokens, lo, min(lo + BLOCK, len(tokens))) for lo in range(0, len(tokens), BLOCK)]
    first, last, answers = (np.concatenate(x) for x in zip(*parts, strict=True))
    of = np.searchsorted(tokens.owner, np.arange(len(rows) + 1))
    owner = tokens.owner[first]
    i, n = first - of[owner], last - first
    gold = np.full(len(first), -1)
    bounds = {(o, a, b): c for c, (o, a, b) in enumerate(zip(owner.tolist(), tokens.start[first].tolist(), tokens.end[last - 1].tolist(), strict=True))}
    usable = np.ones(len(rows), bool)
    for o, (_, spans) in enumerate(rows):
        for a, k, b in spans:
            c = bounds.get((o, a, b))
            if c is None:
                usable[o] = False
            else:
                gold[c] = k
    used = usable[owner]
    first, last, answers, owner, i, n, gold = (x[used] for x in (first, last, answers, owner, i, n, gold))
    if not len(first):
        return weights
    answers, same = np.unique(answers, axis=0, return_inverse=True)
    same = same.ravel()
    sizes = np.diff(of)
    width = int(sizes.max()) + 1
    marked = np.flatnonzero(gold >= 0)
    moments = np.zeros_like(weights)
    rows_at = np.arange(len(rows))
    for _ in range(rounds):
        distinct = scores(answers, weights)
        s = distinct[same]
        dense = np.full((len(rows), width, LONGEST + 1), -np.inf)
        dense[owner, i + n, n] = _log_sum(distinct)[same]
        alpha, beta = np.full((len(rows), width), -np.inf), np.full((len(rows), width), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, width):
            back = np.arange(1, min(j, LONGEST) + 1)
            alpha[:, j] = np.logaddexp(alpha[:, j - 1], _log_sum(alpha[:, j - back] + dense[:, j, back]))
        beta[rows_at, sizes] = 0
        for j in range(width - 2, -1, -1):
            ahead = np.arange(1, min(width - 1 - j, LONGEST) + 1)
            beta[:, j] = np.where(j < sizes, np.logaddexp(beta[:, j + 1], _log_sum(beta[:, j + ahead] + dense[:, j + ahead, ahead])), beta[:, j])
        z = alpha[rows_at, sizes]
        slope = -np.exp((alpha[owner, i] + beta[owner, i + n] - z[owner])[:, None] + s)
        slope[marked, gold[marked]] += 1
        slope = np.stack([np.bincount(same, slope[:, k], len(answers)) for k in range(len(KINDS))], 1)
        gradient = np.zeros_like(weights)
        for c in range(answers.shape[1]):
            for k in range(len(KINDS)):
                gradient[:, k] += np.bincount(answers[:, c], slope[:, k], SIZE)
        gradient = gradient / len(rows) - decay * weights / answers.shape[1]
        moments += gradient**2
        weights += rate * gradient / (np.sqrt(moments) + 1e-8)
    return weights


def train(docs: DataFrame, text_col: str = "text", sample: int = 120) -> np.ndarray | None:
    """Weights of the field, from labelled short texts out of about `sample` different texts in which base rules may find
    something, and as many of all; None if there are none."""
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where("text is not null and text != ''")
    some = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|([0-9][\x20-]?){13}[0-9]|\+[0-9][\x20().0-9-]{8}")
    different = texts.agg(F.approx_count_distinct("h").alias("all"), F.approx_count_distinct(F.when(some, F.col("h"))).alias("some")).first()
    chosen = (share_of_hashes(F.col("h"), sample, F.lit(different["some"])) & some) | share_of_hashes(F.col("h"), sample, F.lit(different["all"]))

    @F.arrow_udf("array<struct<text: string, spans: array<array<int>>>>")
    @freeing
    def made(batch: pa.Array, hashes: pa.Array) -> pa.Array:
        rows = [[{"text": short, "spans": own} for short, own in labelled(t, h)] for t, h in zip(batch.to_pylist(), hashes.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])))

    once = texts.where(chosen).groupBy("h").agg(F.min("text").alias("text"))
    rows = once.select("h", made("text", "h").alias("rows")).collect()
    all_of = [(x["text"], [tuple(s) for s in x["spans"]]) for r in sorted(rows, key=lambda r: r["h"]) for x in r["rows"]]
    return fitted(all_of) if all_of else None


def spans_of(text: Column, weights: np.ndarray | None, cutoff: float = 1.0) -> Column:
    """array<struct<start, rank, end, base>> of a text: base spans, and those that the field adds, by position; rank is the kind's place in KINDS."""

    @F.arrow_udf("array<struct<start: int, rank: int, end: int, base: boolean>>")
    @freeing
    def found(batch: pa.Array) -> pa.Array:
        texts = [t or "" for t in batch.to_pylist()]
        base = [base_spans(t) for t in texts]
        added = added_spans(texts, base, weights, cutoff) if weights is not None else [[] for _ in texts]
        spans = [sorted([*((*x, True) for x in b), *((*x, False) for x in a)]) for a, b in zip(added, base, strict=True)]
        flat = [x for own in spans for x in own]
        columns = [pa.array([x[c] for x in flat], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["start", "rank", "end", "base"]))

    return found(text)


def _kind(span: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), span["rank"])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_report(docs: DataFrame, sample: int = 120, cutoff: float = 1.0) -> DataFrame:
    """doc_id, numbers of base spans by kind, their digest, and all spans."""
    small_batches(docs.sparkSession)
    weights = train(docs, sample=sample)
    rows = docs.select("doc_id", spans_of(F.col("text"), weights, cutoff).alias("s"))
    base = F.filter("s", lambda s: s["base"])
    number = lambda i, kind: F.size(F.filter("s", lambda s: s["base"] & (s["rank"] == i))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *(number(i, kind) for i, kind in enumerate(KINDS)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", sample: int = 120, cutoff: float = 1.0) -> DataFrame:
    """docs with every span of text_col replaced by its kind in angle brackets; of overlapping spans the first counts, and is drawn out."""
    small_batches(docs.sparkSession)
    name = free_name(docs, "personal")
    rows = docs.withColumn(name, spans_of(F.col(text_col), train(docs, text_col, sample), cutoff))
    text, spans = F.col(text_col), F.col(name)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mask = F.concat(F.lit("<"), F.upper(_kind(s)), F.lit(">"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mask)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
    return rows.withColumn(text_col, clean).select(docs.columns)
