"""Speech transcripts into clean speaker turns.

A linear-chain model tags every token of a segment as speaker, timestamp, annotation, filler or
speech; Viterbi decodes the best sequence; segments and turns are assembled from the tags alone. The
model is an averaged structured perceptron. It sees of a token its letters (the word, prefixes, suffixes,
shape, doubled letters made one), whether it occurs in the roster, whether an open bracket will be
closed, its place in the line, and the same of its neighbours; tags of neighbours enter as transitions.
Which of that makes a label, a clock time, an annotation or a filler is learned, not written down.

It is trained here, on hand-labelled lines (seed_lines) and on at most ``train_rows`` transcript rows that
label themselves: a row's ``words`` hold what was spoken, so aligning text and words tells spoken tokens
from the rest (self_label; its patterns serve only this labelling).

Texts are decoded an Arrow batch at a time: each distinct token is looked at once, scores are table
lookups, and all sequences of a batch advance through Viterbi together.

Turns are found by ordered passes over (run, time block): the last known speaker and the number of
turns so far enter a block through one summary row per block, so a run never lies in one task.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.session import materialise
from chronoloom.timekeys import floor_div, seconds_to_ms

TAGS = ("speaker", "timestamp", "annotation", "filler", "speech")
SPEAKER, TIMESTAMP, ANNOTATION, FILLER, SPEECH = range(5)

# Number words that a speaker label may use.
UNITS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = {w: n for n, w in enumerate(UNITS)} | {t: 10 * k for k, t in enumerate(TENS, 2)} | {f"{t} {u}": 10 * k + n for k, t in enumerate(TENS, 2) for n, u in enumerate(UNITS[:10]) if n}
NUMBER_PARTS = frozenset([*UNITS, *TENS])
# Parts of hand-labelled lines. A body's tokens carry the first letter of their tag, z for speech.
LABEL_FORMS = ("", "Operator:", "**Operator:**", ">> OPERATOR:", "[Operator]", "(Operator)", "<operator>", "operator -", "Operator. :", "Operator ：", "S1:", "SPK_01:", "Speaker 1:", "speaker one:", "Oprator:", "Sound Desk:", "**Sound Desk:**", ">> SOUND DESK:", "[Sound Desk]", "(Sound Desk)", "<sound_desk>", "sound desk -", "Sound-Desk. :", "Sound Desk ：", "Sond Desk:")
CLOCK_FORMS = ("", "[00:00:45]", "(00:53)", "<00:55.8>", "1:24", "00:00:24.986 --> 00:00:26.986")
BODIES = (
    "hold/z on/z um/f the/z bell/z", "right/z um/f --/z so/z the/z door/z", "can/z you/z look/z up/z", "We/z lost/z erm.../f the/z lamp/z", "note:/z the/z curtain/z is/z out/z of/z frame/z",
    "warning:/z the/z belt/z moved/z", "Note:/z the/z lamp/z fell/z (applause)/a", "the/z gate/z [/a hum/a of/a a/a fan/a ]/a is/z here/z", "*clears/a throat*/a Um.../f yes/z", "♪/a uh-huh/f",
    "{static}/a mm-hmm,/f okay/z <noise>/a", "(sighs/a softly)/a I/z think/z so/z", "[music]/a that/z is/z 24/z onsets/z", "the/z door/z at/z 10:30/t", "in/z about/z 45/z seconds/z hm/f", "yes/z",
    "the/z sound/z [crosstalk]/a uh.../f came/z back/z", "Umm/f um.../f", "45/z seconds/z in/z",
)


def seed_lines() -> list[list[tuple[str, str]]]:
    """Hand-labelled lines: every label form with every clock form, before and after it, over bodies in turn."""
    out = []
    for label in LABEL_FORMS:
        for clock in CLOCK_FORMS:
            parts = [[(x, "s") for x in label.split()], [(x, "t") for x in clock.split()]]
            for order in (parts, parts[::-1])[: 2 if label and clock else 1]:
                for k in range(3):
                    body = BODIES[(len(out) + k) % len(BODIES)]
                    out.append([*order[0], *order[1], *[tuple(x.rsplit("/", 1)) for x in body.split()]])
    return out


# What composed lines are made of. {n} a roster name, {u} in capitals, {l} small with '_', {h} with '-', {i} its number, {w} its number word.
NAME_FORMS = ("{n}:", "**{n}:**", ">> {u}:", "[{n}]", "({n})", "<{l}>", "{s} -", "{h}. :", "{n} ：", "S{i}:", "SPK_0{i}:", "Speaker {i}:", "speaker {w}:")
OTHER_HEADS = ("note:", "warning:", "Stranger:", "and then:", "The speaker", "one more thing:", "stack:")
FILLERS = ("um", "uh", "er", "erm", "hm", "mm", "mhm", "uhm", "mm-hmm", "uh-huh", "ah", "eh")
ENDS = ("", "", "", ",", ".", "...", "?", "!")
SOUNDS = ("[music]", "♪", "♫", "(applause)", "[ hum of a fan ]", "*door slams*", "*clears throat*", "<noise>", "{static}", "[CROSSTALK]", "(sighs softly)", "(laughs)", "[inaudible]", "[BLANK_AUDIO]")


def composed_lines(bodies: list[list[str]], roster: Roster, n: int) -> list[list[tuple[str, str]]]:
    """``n`` lines put together from spoken words: label and clock before them, fillers and sounds among them.

    The same for the same input. Labels are spelled in every form, some with a letter wrong; some heads mean nobody.
    """
    rng = random.Random(20261014)
    names = sorted(roster.titles.items()) or [(0, "Nobody")]
    spelled_number = {n: w for w, n in NUMBERS.items()}
    plain = [w for body in bodies for w in body] or ["well"]
    parts = sorted(roster.parts) or ["well"]
    out = []

    def typo(x: str) -> str:
        k = rng.randrange(len(x))
        return rng.choice((x[:k] + x[k + 1 :], x[:k] + rng.choice("aeinst") + x[k:], x[:k] + rng.choice("aeinst") + x[k + 1 :]))

    def filler() -> str:
        x = rng.choice(FILLERS)
        x = x + x[-1] * rng.choice((0, 0, 1, 2)) if rng.random() < 0.7 else x[0] + x
        return (x.capitalize() if rng.random() < 0.3 else x) + rng.choice(ENDS)

    def sound() -> str:
        if rng.random() < 0.25:
            a, b = rng.choice(("[]", "()", "**", "{}", "<>"))
            return a + " ".join(rng.choice(plain).strip(".,?!*") or "x" for _ in range(rng.choice((2, 3, 5, 9, 14)))) + b
        x = rng.choice(SOUNDS) + (rng.choice(ENDS) if rng.random() < 0.3 else "")
        return x.upper() if rng.random() < 0.2 else x

    for _ in range(n):
        i, name = rng.choice(names)
        label = rng.choice(NAME_FORMS)
        spelled = typo(name) if rng.random() < 0.2 else name
        low = spelled.lower()
        head = label.format(n=spelled, u=spelled.upper(), s=low, l=low.replace(" ", "_"), h=spelled.replace(" ", "-"), i=i, w=spelled_number.get(i, i))
        lead = [(x, "s") for x in head.split()] if roster.meant(head) is not None and rng.random() < 0.7 else []
        clock = [(x, "t") for x in rng.choice(CLOCK_FORMS).split()] if rng.random() < 0.5 else []
        line = lead + clock if rng.random() < 0.3 else clock + lead
        if rng.random() < 0.15:
            line += [(x, "a") for x in sound().split()]
        body = [(w, "z") for w in rng.choice(bodies)] if bodies and rng.random() > 0.2 else []
        if not body and rng.random() < 0.5:
            line = []
        if body and rng.random() < 0.15:
            body = [(x, "z") for x in rng.choice(OTHER_HEADS).split()] + body
        elif body and rng.random() < 0.3:
            body[0] = (body[0][0].capitalize(), "z")
        for _ in range(rng.choice((0, 0, 1, 2)) if body else 0):  # names and numbers are spoken as well
            body.insert(rng.randrange(len(body) + 1), (rng.choice(parts) if rng.random() < 0.6 else str(rng.randrange(100)), "z"))
        body = [(w + rng.choice(ENDS[3:]) if rng.random() < 0.08 and w[-1].isalnum() else w, g) for w, g in body]
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3) if body else (1, 2, 3))):
            k = rng.randrange(len(body) + 1)
            if any(g == "a" for _, g in body[max(k - 1, 0) : k + 1]):
                continue
            body[k:k] = [(filler(), "f")] if rng.random() < 0.6 else [(x, "a") for x in sound().split()]
        if rng.random() < 0.08:
            body.insert(rng.randrange(len(body) + 1), ("--" + rng.choice(ENDS), "z"))
        out.append(line + body)
    return [line for line in out if line]


_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_CLOCK = re.compile(r"[\[(<{]*\d{1,3}(?::\d{2}){1,2}(?:[.,]\d+)?[\])>},.?!]*")
_SOUND = re.compile(r"u+h*m+|u+h+m*|e+r+m*|h+m+|m{2,}|m+h+m+|m+-h+m+|u+h+-?h+u+h+|a+h+|e+h+")
_OPEN = {"[": "]", "(": ")", "<": ">", "{": "}", "*": "*"}


def squeeze(label: str) -> str:
    """A label's letters and digits: 'Sound-Desk. :' and '<sound_desk>' both give 'sound desk'."""
    return " ".join(re.sub(r"[\W_]+", " ", label.casefold()).split())


def _one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def _less_one(word: str) -> set[str]:
    return {word[:k] + word[k + 1 :] for k in range(len(word))} | {word}


@dataclass
class Roster:
    """Possible speakers. A label means the one with its name, with its number, or with the only name one letter away."""

    names: dict[str, int]
    ids: frozenset[int]
    titles: dict[int, str]
    parts: frozenset[str]  # words of the names
    near: frozenset[str]  # those of three letters and more, with any one letter left out
    known: dict[str, int | None] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable[tuple[int, str]]) -> Roster:
        rows = [(i, squeeze(n)) for i, n in rows if i is not None and n]
        parts = frozenset(p for _, n in rows for p in n.split())
        near = frozenset(x for p in parts if len(p) > 2 for x in _less_one(p))
        return cls({n: i for i, n in sorted(rows, reverse=True)}, frozenset(i for i, _ in rows), {i: n.title() for i, n in sorted(rows, reverse=True)}, parts, near)

    def meant(self, label: str) -> int | None:
        label = squeeze(label)
        if len(label) > 200:
            return self._meant(label)
        if label not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[label] = self._meant(label)
        return self.known[label]

    def _meant(self, label: str) -> int | None:
        if label in self.names:
            return self.names[label]
        if m := re.fullmatch(r"(?:s|spk|speaker)(?: ?(\d{1,9})| ([a-z]+(?: [a-z]+)?))", label):
            n = int(m[1]) if m[1] else NUMBERS.get(m[2], -1)
            return n if n in self.ids else None
        near = {i for n, i in self.names.items() if len(n) > 3 and _one_edit(label, n)}
        return near.pop() if len(near) == 1 else None


def tokens(text: str) -> list[str]:
    return text.split()


def _brackets(toks: list[str]) -> list[tuple[int, int, str]]:
    """(first, last, kind) of closed bracket groups, however long."""
    out, i = [], 0
    unclosed: set[str] = set()  # what no later token closes is not searched for again
    while i < len(toks):
        opener = "**" if toks[i].startswith("**") else toks[i][0]
        close = "**" if opener == "**" else _OPEN.get(opener)
        if close and close not in unclosed:
            for j in range(i, len(toks)):
                if close in (toks[j][len(opener) :] if j == i else toks[j]):
                    out.append((i, j, opener))
                    i = j
                    break
            else:
                unclosed.add(close)
        i += 1
    return out


_DIGITS = str.maketrans("0123456789", "0" * 10)
_CLOSE = {"[": "]", "(": ")", "<": ">", "{": "}", "*": "*"}
_PLACES = 5
_CLASSES = 512


def _kind(c: str) -> str:
    if c.isalpha():
        return "a"
    return "0" if c.isdecimal() else "♪" if unicodedata.category(c) == "So" else c


@dataclass(frozen=True)
class Seen:
    """What the model sees of one token: features of its own, features for its neighbours, its class, its brackets."""

    own: tuple[str, ...]
    beside: tuple[str, ...]
    kind: str
    opens: str
    closes: str


def seen(tok: str, roster: Roster) -> Seen:
    low = tok.casefold()
    bare = _TRIM.sub("", low)
    parts = re.sub(r"[\W_]+", " ", bare).split()
    head = re.sub(r"0+$", "", bare.replace("_", ""))
    if parts and all(p in roster.parts for p in parts):
        known = "name"
    elif bare and head in ("s", "spk", "speaker"):
        known = "spk0" if head != bare.replace("_", "") else "spk"
    elif parts and all(p in NUMBER_PARTS for p in parts):
        known = "number"
    elif len(bare) > 1 and not _less_one(bare).isdisjoint(roster.near):
        known = "near"
    else:
        known = "digits" if bare and not bare.strip("0") else "word" if bare else "none"
    first, last = _kind(tok[0]), _kind(tok.rstrip("*")[-1:] or "*")
    last = ":" if last == "：" else last
    short = re.sub(r"(.)\1+", r"\1", bare)[:16]
    shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else _kind(c) for c in tok[:40]))[:14]
    kind = f"{first}{known}{last}"
    own = (f"w={short}", f"p2={low[:2]}", f"s2={low[-2:]}", f"p3={short[:3]}", f"s3={short[-3:]}", f"x={shape}", f"r={known}", f"e={last}", f"k={kind}")
    opens = next((o for o, c in _CLOSE.items() if tok[0] == o and c not in tok.lstrip(o)), "")
    closes = "".join(c for o, c in _CLOSE.items() if c in tok and (c != "*" or tok[0] != "*"))
    if not opens and tok[0] in _CLOSE:
        closes = "!"  # closed in itself
    return Seen(own, (f"w={short}", f"x={shape}", f"r={known}", f"k={kind}"), kind, opens, closes)


@dataclass
class Batch:
    """Tokens of many texts one after another: rows of the table of distinct tokens, texts' begins, brackets, places."""

    ids: np.ndarray
    begin: np.ndarray
    inside: np.ndarray
    place: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.begin)


class Lexicon(dict):
    """Rows of distinct tokens (digits as 0), each looked at once."""

    def __init__(self, roster: Roster):
        super().__init__()
        self.roster, self.rows, self.opens, self.closes = roster, [], [], []

    def __missing__(self, tok: str) -> int:
        row = seen(tok, self.roster)
        self[tok] = n = len(self.rows)
        self.rows.append(row)
        self.opens.append("[(<{*".find(row.opens) if row.opens else -1)
        self.closes.append(sum(1 << k for k, c in enumerate("])>}*") if c in row.closes) | (32 if row.closes == "!" else 0))
        return n

    def batch(self, texts: list[list[str]]) -> Batch:
        begin = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        ids = np.fromiter((self[x] for t in texts for x in t), np.int64, int(begin[-1]))
        sizes = np.diff(begin)
        first, end = np.repeat(begin[:-1], sizes), np.repeat(begin[1:], sizes)
        at = np.arange(len(ids))
        opens, closes = np.array(self.opens, np.int64)[ids] if len(ids) else at, np.array(self.closes, np.int64)[ids] if len(ids) else at
        # 0 outside; 2 k + 1 within a bracket of kind k that is closed later in the text; 2 k + 2 where it closes; 11 closed in itself.
        inside = np.where(closes & 32, 11, 0)
        for k in range(5):
            shut = (closes >> k & 1).astype(bool)
            if not (opens == k).any():
                continue
            opened = np.maximum.accumulate(np.where(opens == k, at, -1))
            before = np.concatenate(([-1], np.maximum.accumulate(np.where(shut, at, -1))[:-1]))
            after = np.minimum.accumulate(np.where(shut, at, len(at))[::-1])[::-1]
            within = (opened >= first) & (opened > before) & (after < end) & (inside == 0)
            inside = np.where(within, np.where(shut & (opens != k), 2 * k + 2, 2 * k + 1), inside)
        return Batch(ids, begin, inside, np.minimum(at - first, _PLACES - 1))


def _pair(kind: str, a: str, b: str) -> str:
    return f"{kind}|{a}|{b}"


def features(lexicon: Lexicon, batch: Batch, i: int) -> list[list[str]]:
    """The features of each token of the batch's text ``i``, spelled out."""
    a, b = int(batch.begin[i]), int(batch.begin[i + 1])
    rows = [lexicon.rows[k] for k in batch.ids[a:b]]
    out = []
    for n, row in enumerate(rows):
        f = [*row.own, _pair("in", str(batch.inside[a + n]), row.kind), _pair("at", str(batch.place[a + n]), row.kind)]
        f += [_pair("in2", str(batch.inside[a + n]), row.kind[1:-1])]
        f += [f"-{x}" for x in (rows[n - 1].beside if n else ("start",))]
        f += [f"+{x}" for x in (rows[n + 1].beside if n + 1 < len(rows) else ("end",))]
        f.append(_pair("-k", rows[n - 1].kind if n else "", row.kind))
        f.append(_pair("+k", row.kind, rows[n + 1].kind if n + 1 < len(rows) else ""))
        f.append(_pair("+2k", row.kind, rows[n + 2].kind if n + 2 < len(rows) else ""))
        out.append(f)
    return out


def feature_numbers(lexicon: Lexicon, batch: Batch, names: dict[str, int]) -> np.ndarray:
    """What features() spells out for every token of the batch, as numbers that ``names`` is extended by."""
    number = lambda x: names.setdefault(x, len(names))
    rows, ids, n = lexicon.rows, batch.ids, len(batch.ids)
    own = np.array([[number(x) for x in r.own] for r in rows])
    prior = np.array([[number(f"-{x}") for x in r.beside] for r in rows])
    later = np.array([[number(f"+{x}") for x in r.beside] for r in rows])
    place = np.arange(n)
    begin, end = np.repeat(batch.begin[:-1], batch.sizes), np.repeat(batch.begin[1:], batch.sizes)

    def beside(table: np.ndarray, by: int, edge: str) -> np.ndarray:
        inside = (place + by >= begin) & (place + by < end)
        none = np.array([number(edge)] + [-1] * (table.shape[1] - 1))
        return np.where(inside[:, None], table[ids[np.where(inside, place + by, 0)]], none)

    kinds = sorted({r.kind for r in rows})
    kind = np.searchsorted(kinds, [r.kind for r in rows])[ids]
    at = lambda by: np.where((place + by >= begin) & (place + by < end), kind[np.clip(place + by, 0, n - 1)], len(kinds))
    spelled = [*kinds, ""]

    def pairs(a: np.ndarray, b: np.ndarray, say: Callable[[int, int], str]) -> np.ndarray:
        code = a * (len(kinds) + 1) + b
        met, back = np.unique(code, return_inverse=True)
        return np.array([number(say(*divmod(int(c), len(kinds) + 1))) for c in met])[back][:, None]

    return np.concatenate((
        own[ids], pairs(batch.inside, kind, lambda x, y: _pair("in", str(x), spelled[y])), pairs(batch.place, kind, lambda x, y: _pair("at", str(x), spelled[y])),
        pairs(batch.inside, kind, lambda x, y: _pair("in2", str(x), spelled[y][1:-1])), beside(prior, -1, "-start"), beside(later, 1, "+end"),
        pairs(at(-1), kind, lambda x, y: _pair("-k", spelled[x], spelled[y])), pairs(kind, at(1), lambda x, y: _pair("+k", spelled[x], spelled[y])), pairs(kind, at(2), lambda x, y: _pair("+2k", spelled[x], spelled[y])),
    ), axis=1)


def viterbi(scores: np.ndarray, begin: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tag of every token, all sequences at once; of equal ones the smaller tag."""
    n, sizes = len(TAGS), np.diff(begin)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    tags = np.zeros(len(scores), np.int64)
    if not len(order):
        return tags
    at, length = begin[order], sizes[order]
    longest = int(length[0])
    alive = len(length) - np.searchsorted(length[::-1], np.arange(longest), side="right")  # sequences longer than t
    back = np.zeros((len(scores), n), np.int8)
    best = steps[n] + scores[at]
    for t in range(1, longest):
        k = alive[t]
        ways = best[:k, :, None] + steps[:n]
        back[at[:k] + t] = ways.argmax(axis=1)
        best[:k] = ways.max(axis=1) + scores[at[:k] + t]
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        tags[at[:k] + t] = now[:k]
        if t:
            now[:k] = back[at[:k] + t, now[:k]]
    return tags


@dataclass
class Tagger:
    """Weights by feature (one number per tag) and by pair of neighbouring tags; row 5 of steps is the start."""

    weights: dict[str, np.ndarray]
    steps: np.ndarray

    def __getstate__(self):
        return {"weights": self.weights, "steps": self.steps}

    def _sum(self, names) -> np.ndarray:
        out = np.zeros(len(TAGS))
        for x in names:
            if (w := self.weights.get(x)) is not None:
                out += w
        return out

    def _tables(self, lexicon: Lexicon) -> None:
        """Extend the score tables to the lexicon's rows: per distinct token, and per pair of token classes."""
        if getattr(self, "_of", None) is not lexicon:
            self._of, self._kinds = lexicon, {"": 0}
            self._rows, self._kind = np.zeros((0, 3, len(TAGS))), np.zeros(0, np.int64)
            self._cells = {k: (np.zeros((_CLASSES, _CLASSES, len(TAGS))), np.zeros((_CLASSES, _CLASSES), bool)) for k in ("-k", "+k", "+2k", "in", "at")}
        new = lexicon.rows[len(self._rows) :]
        if not new:
            return
        more = np.array([[self._sum(r.own), self._sum(f"-{x}" for x in r.beside), self._sum(f"+{x}" for x in r.beside)] for r in new])
        kinds = [self._kinds.setdefault(r.kind, len(self._kinds)) if r.kind in self._kinds or len(self._kinds) < _CLASSES else _CLASSES for r in new]
        self._rows, self._kind = np.concatenate((self._rows, more)), np.concatenate((self._kind, kinds))

    def _cell(self, name: str, a: np.ndarray, b: np.ndarray, say) -> np.ndarray:
        """Weights of pairs, looked up by name the first time each is met; classes past the table have none."""
        table, known = self._cells[name]
        ok = (a < _CLASSES) & (b < _CLASSES)
        a, b = np.where(ok, a, 0), np.where(ok, b, 0)
        fresh = ~known[a, b]
        if fresh.any():
            for x, y in np.unique(np.stack((a[fresh], b[fresh]), axis=1), axis=0).tolist():
                table[x, y], known[x, y] = self._sum(say(x, y)), True
        return table[a, b] * ok[:, None]

    def scores(self, lexicon: Lexicon, batch: Batch) -> np.ndarray:
        self._tables(lexicon)
        names = list(self._kinds)
        ids, n = batch.ids, len(batch.ids)
        if not n:
            return np.zeros((0, len(TAGS)))
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        some = batch.begin[:-1][batch.sizes > 0]
        first[some] = True
        last[(batch.begin[1:] - 1)[batch.sizes > 0]] = True
        kind = self._kind[ids]
        before, after = np.roll(ids, 1), np.roll(ids, -1)
        out = self._rows[ids, 0]
        out = out + np.where(first[:, None], self._sum(["-start"]), self._rows[before, 1]) + np.where(last[:, None], self._sum(["+end"]), self._rows[after, 2])
        out += self._cell("in", batch.inside, kind, lambda x, y: (_pair("in", str(x), names[y]), _pair("in2", str(x), names[y][1:-1])))
        out += self._cell("at", batch.place, kind, lambda x, y: (_pair("at", str(x), names[y]),))
        out += self._cell("-k", np.where(first, 0, np.roll(kind, 1)), kind, lambda x, y: (_pair("-k", names[x], names[y]),))
        out += self._cell("+k", kind, np.where(last, 0, np.roll(kind, -1)), lambda x, y: (_pair("+k", names[x], names[y]),))
        later = np.where(last | np.roll(last, -1), 0, np.roll(kind, -2))
        out += self._cell("+2k", kind, later, lambda x, y: (_pair("+2k", names[x], names[y]),))
        return out

    def decode(self, lexicon: Lexicon, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(tags of all tokens one after another, begins of the texts). Tokens have their digits as 0."""
        batch = lexicon.batch(texts)
        return viterbi(self.scores(lexicon, batch), batch.begin, self.steps), batch.begin


def self_label(text: str, words: list[str], roster: Roster) -> list[int] | None:
    """Tags of a row from its aligned words; None where words and text cannot be aligned."""
    toks, out, w = tokens(text), [], 0
    spoken = [_TRIM.sub("", x.casefold()) for x in words]
    spoken = [x for x in spoken if x]
    matched = [-1] * len(toks)
    for i in range(len(toks) - 1, -1, -1):  # labels stand before the speech, so align from the end
        bare = _TRIM.sub("", toks[i].casefold())
        if bare and w < len(spoken) and bare == spoken[len(spoken) - 1 - w]:
            matched[i] = w
            w += 1
    if w < len(spoken):
        return None
    groups = {k: kind for i, j, kind in _brackets(toks) for k in range(i, j + 1)}
    named = {k for i, j, _ in _brackets(toks) for k in range(i, j + 1) if roster.meant(" ".join(toks[i : j + 1])) is not None}
    started = False
    for i, tok in enumerate(toks):
        bare = _TRIM.sub("", tok.casefold())
        if matched[i] >= 0:
            started = True
            out.append(FILLER if _SOUND.fullmatch(bare) else SPEECH)
        elif _CLOCK.fullmatch(tok) or tok == "-->":
            out.append(TIMESTAMP)
        elif set(tok) & set("♪♫♬") or (i in groups and i not in named):
            out.append(ANNOTATION)
        elif not started:
            out.append(SPEAKER)
        elif not bare:
            out.append(SPEECH)
        else:
            return None
    return out


def train(rows: list[tuple[str, list[str]]], roster: Roster, epochs: int = 10, at_once: int = 32, composed: int = 4000) -> Tagger:
    """Averaged structured perceptron over seed_lines, the rows that label themselves and composed_lines.

    Weights change after every ``at_once`` lines; the result is the mean of all weights met on the way.
    """
    first = {"s": SPEAKER, "t": TIMESTAMP, "a": ANNOTATION, "f": FILLER, "z": SPEECH}
    names: dict[str, int] = {}
    lines: list[tuple[np.ndarray, np.ndarray]] = []  # features and tags of a line

    def take(lexicon: Lexicon, data: list[tuple[list[str], list[int]]]) -> None:
        if data:
            batch = lexicon.batch([[x.translate(_DIGITS) for x in toks] for toks, _ in data])
            every = feature_numbers(lexicon, batch, names)
            lines.extend((every[a:b], np.array(g)) for a, b, (_, g) in zip(batch.begin.tolist(), batch.begin[1:].tolist(), data))

    take(Lexicon(Roster.of([(1, "Operator"), (2, "Sound Desk")])), [([a for a, _ in line], [first[b] for _, b in line]) for line in seed_lines()])
    own = [(tokens(text), gold) for text, words in rows if (gold := self_label(text, words, roster)) is not None]
    take(Lexicon(roster), [(toks, gold) for toks, gold in own if toks])
    spoken = [[t for t, g in zip(toks, gold) if g == SPEECH] for toks, gold in own]
    spoken = [x for x in spoken if x] or [[t for t, g in line if g == "z"] for line in seed_lines()]
    take(Lexicon(roster), [([a for a, _ in line], [first[b] for _, b in line]) for line in composed_lines(spoken, roster, composed)])
    lines = [lines[k] for k in np.argsort([k * 0.6180339887498949 % 1.0 for k in range(len(lines))], kind="stable")]  # mixed evenly

    ids, gold = [f for f, _ in lines], [g for _, g in lines]
    n = len(TAGS)
    w, total = np.zeros((len(names) + 1, n)), np.zeros((len(names) + 1, n))  # the last row stands for "no feature"
    steps, step_total = np.zeros((n + 1, n)), np.zeros((n + 1, n))
    clock = 1
    for _ in range(epochs):
        wrong = 0
        for lo in range(0, len(lines), at_once):
            f, g = np.concatenate(ids[lo : lo + at_once]), np.concatenate(gold[lo : lo + at_once])
            begin = np.concatenate(([0], np.cumsum([len(x) for x in gold[lo : lo + at_once]])))
            p = viterbi(w[f].sum(axis=1), begin, steps)
            off = p != g
            if off.any():
                wrong += int(off.sum())
                change, turn = np.zeros_like(w), np.zeros_like(steps)
                for tags, by in ((g, 1.0), (p, -1.0)):
                    np.add.at(change, (f[off].ravel(), np.repeat(tags[off], f.shape[1])), by)
                    prior = np.concatenate(([n], tags[:-1]))
                    prior[begin[:-1]] = n
                    np.add.at(turn, (prior, tags), by)
                change[-1] = 0.0
                w += change
                steps += turn
                total += clock * change
                step_total += clock * turn
            clock += 1
        if not wrong:
            break
    w, steps = w - total / clock, steps - step_total / clock
    return Tagger({x: w[k] for x, k in names.items() if w[k].any()}, steps)


class Reader:
    """A tagger with its roster and what it has learned about tokens so far."""

    MOST = 200_000  # distinct tokens remembered; then it starts afresh

    def __init__(self, tagger: Tagger, roster: Roster):
        self.tagger, self.roster, self.lexicon = tagger, roster, Lexicon(roster)

    def read(self, texts: list[str]) -> list[tuple[int | None, str]]:
        """(speaker or None, clean text) of every segment. A label that means nobody is speech."""
        if len(self.lexicon) > self.MOST:
            self.lexicon = Lexicon(self.roster)
        toks = [t.split() for t in texts]
        tags, begin = self.tagger.decode(self.lexicon, [t.translate(_DIGITS).split() for t in texts])
        out, every, begin = [], tags.tolist(), begin.tolist()
        for own, a, b in zip(toks, begin, begin[1:]):
            mine = every[a:b]
            label = [t for t, g in zip(own, mine) if g == SPEAKER] if SPEAKER in mine else []
            who = self.roster.meant(" ".join(label)) if label else None
            kept = (SPEECH,) if not label or who is not None else (SPEECH, SPEAKER)
            out.append((who, " ".join([t for t, g in zip(own, mine) if g in kept])))
        return out


def read_segment(text: str, tagger: Tagger, roster: Roster) -> tuple[int | None, str]:
    return Reader(tagger, roster).read([text])[0]


def fit_tagger(segments: DataFrame, roster: Roster, *, text: str, words: str, id: str, train_rows: int = 2000, train_chars: int = 2000) -> Tagger:
    """Train on the ``train_rows`` rows (of at most ``train_chars`` characters) first in hash order of id."""
    has = segments.filter(F.col(text).isNotNull() & (F.length(text) <= train_chars) & F.col(words).isNotNull())
    picked = has.select(F.col(text).alias("text"), F.transform(words, lambda w: w["word"]).alias("words"), F.xxhash64(F.col(id)).alias("at"), F.col(id).alias("id"))
    rows = picked.orderBy("at", "id", "text").limit(train_rows).collect()
    return train([(r["text"], [w for w in r["words"] if w]) for r in rows], roster)


def clean_segments(segments: DataFrame, tagger: Tagger, roster: Roster, *, run: str, id: str, start: str, text: str, words: str) -> DataFrame:
    """(run_id, seg_id, start_ms, speaker_id or null, clean): segments with a word left, repeats removed."""
    spoken = F.array_join(F.transform(F.filter(words, lambda w: w["word"].isNotNull()), lambda w: F.trim(w["word"])), " ")
    first = F.array_min(F.transform(words, lambda w: w["start"]))
    slim = segments.filter(F.col(run).isNotNull()).select(
        F.col(run).alias("run_id"), F.col(id).alias("seg_id"), F.coalesce(seconds_to_ms(start), seconds_to_ms(first)).alias("start_ms"),
        F.coalesce(F.col(text), spoken).alias("text"),
    ).filter("text is not null and text <> ''")
    # Repeats of a row go before the model sees them; partial aggregation collapses copies in place.
    slim = slim.distinct()
    shared = slim.sparkSession.sparkContext.broadcast((tagger, roster))  # the roster has at most max_speakers names

    @F.pandas_udf("speaker_id bigint, clean string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value)
        for texts in batches:
            got = reader.read(texts.tolist())
            yield pd.DataFrame({"speaker_id": pd.array([w for w, _ in got], dtype="Int64"), "clean": [c for _, c in got]})

    # Marked so that the test on its answer is not pushed below the distinct, where it would run twice.
    out = slim.withColumn("got", read.asNondeterministic()("text")).select("run_id", "seg_id", "start_ms", "got.*")
    return out.filter(F.col("clean").rlike(r"[\p{L}\p{N}]"))


def label_turns(clean: DataFrame, *, block_ms: int = 600_000) -> DataFrame:
    """``clean`` with the carried-on speaker and turn number (from 1 per run).

    Segments are ordered by start (null last), then id. Without a label the speaker is that of the
    segment before, 0 before the first label. Successive segments of one speaker are one turn.
    """
    last = F.lit((1 << 62) - 1).cast("bigint")
    rows = clean.withColumn("at", F.coalesce("start_ms", last)).withColumn("block", floor_div("at", block_ms))
    within = Window.partitionBy("run_id", "block").orderBy("at", F.col("seg_id").asc_nulls_last(), "clean")
    order = F.struct("at", F.col("seg_id").isNull().alias("late"), "seg_id", "clean")
    before = Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    spoke = rows.groupBy("run_id", "block").agg(F.max_by("speaker_id", F.when(F.col("speaker_id").isNotNull(), order)).alias("who"))
    spoke = spoke.select("run_id", "block", F.last("who", ignorenulls=True).over(before).alias("who_in"), F.count(F.lit(1)).over(before).alias("blocks_in"))
    rows = rows.join(spoke, ["run_id", "block"])
    rows = rows.withColumn("who", F.coalesce(F.last("speaker_id", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "who_in", F.lit(0)))
    first = F.when(F.col("blocks_in") > 0, F.coalesce("who_in", F.lit(0)))
    rows = rows.withColumn("n", F.row_number().over(within)).withColumn("prior", F.when(F.col("n") == 1, first).otherwise(F.lag("who").over(within)))
    rows = rows.withColumn("opens", F.when(F.col("prior").isNull() | (F.col("prior") != F.col("who")), 1).otherwise(0).cast("bigint"))
    rows = rows.withColumn("local", F.sum("opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))

    opened = rows.groupBy("run_id", "block").agg(F.sum("opens").alias("n_open"))
    opened = opened.select("run_id", "block", F.coalesce(F.sum("n_open").over(before), F.lit(0)).alias("base"))
    return rows.join(opened, ["run_id", "block"]).select("run_id", (F.col("base") + F.col("local")).alias("turn_no"), F.col("who").alias("speaker_id"), "seg_id", "start_ms", "at", "block", "clean")


def speaker_turns(segments: DataFrame, speakers: DataFrame, *, run="run_id", id="seg_id", start="start_s", text="text", words="words", speaker_id="speaker_id", display_name="display_name", train_rows: int = 2000, block_ms: int = 600_000, max_speakers: int = 10_000) -> DataFrame:
    """One row per segment with a word left: (run_id, turn_no, speaker_id, seg_id, start_ms, at, block, clean).

    Rows without a run are left out; a null text is replaced by its words, and a segment without
    either, or whose text holds only labels, clock times, annotations and fillers, is dropped before
    speakers are carried on. A segment without any time comes last. Repeated rows are one row. Empty
    tables give no rows; an empty roster leaves every turn with speaker 0.
    """
    listed = speakers.select(F.col(speaker_id).cast("bigint"), F.col(display_name)).distinct().limit(max_speakers + 1).collect()
    if len(listed) > max_speakers:
        raise ValueError(f"more than {max_speakers} speakers")
    roster = Roster.of([(r[0], r[1]) for r in listed])
    tagger = fit_tagger(segments, roster, text=text, words=words, id=id, train_rows=train_rows)
    # The model reads each text once; the passes below come back to its answers four times.
    clean = materialise(clean_segments(segments, tagger, roster, run=run, id=id, start=start, text=text, words=words))
    return label_turns(clean, block_ms=block_ms)


def turn_spans(labelled: DataFrame) -> DataFrame:
    """(run_id, turn_no, first_seg_id, last_seg_id, speaker_id, start_ms, n_segments): one row per turn."""
    order = F.struct("at", F.col("seg_id").isNull().alias("late"), "seg_id", "clean")
    return labelled.groupBy("run_id", "turn_no").agg(
        F.min_by("seg_id", order).alias("first_seg_id"), F.max_by("seg_id", order).alias("last_seg_id"),
        F.first("speaker_id").alias("speaker_id"), F.min("start_ms").alias("start_ms"), F.count(F.lit(1)).alias("n_segments"),
    )


def turn_texts(labelled: DataFrame) -> DataFrame:
    """(run_id, turn_no, piece_no, speaker_id, text): clean text of each turn.

    A turn's text comes in one piece per time block that it touches, in order, so a turn that never
    ends is no unbounded row.
    """
    pieces = labelled.groupBy("run_id", "turn_no", "block").agg(
        F.first("speaker_id").alias("speaker_id"), F.sort_array(F.collect_list(F.struct("at", F.col("seg_id").isNull().alias("late"), "seg_id", "clean"))).alias("parts")
    )
    numbered = pieces.withColumn("piece_no", F.row_number().over(Window.partitionBy("run_id", "turn_no").orderBy("block")))
    return numbered.select("run_id", "turn_no", "piece_no", "speaker_id", F.array_join(F.transform("parts", lambda p: p["clean"]), " ").alias("text"))
