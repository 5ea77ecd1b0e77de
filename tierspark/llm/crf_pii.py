"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail and IP addresses, card and phone numbers in their plain forms. The field, trained
on a small labelled table, tags words by their shapes and those of their neighbours, and finds other
written forms and secrets. Its spans are added where no pattern span lies.

Decoding is exact but skips almost everything: a word whose shape favours "no personal data" in any context
by more than transitions could ever make up for is certain to be so. Only the runs of words between such
words are decoded, by Viterbi on whole batches of runs in numpy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspark.llm.common import bounded, pick, sliced

# The kinds in their order, and the patterns of the plain forms.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's match never begins within a run of digits, unless an earlier match ended there.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^ \t-\r]+")
DIGIT = re.compile("[0-9]")

# The labelled table: each line marks spans as [kind text].
LABELLED = """
please write to [email ann.lee@mail.example.org] before noon
her address is [email bob_77@post7.example.com], he said
the list goes to [email info@shop.example.net] and others
contact [email carla.diaz%home@uni.example.edu] for more.
mail [email dan(at)mail.example.org] or come by
reach me at [email eve[at]post.example.com] any day
we met.[email 30@mail1.example.com] and then left
the host [ip 10.20.30.40] did not answer
traffic from [ip 192.168.1.254] was dropped, then resumed
server [ip 203.0.113.9], port open
ping [ip 8.8.4.4]. It works
paid with [card 4111111111111111] last week
card [card 5500 0000 0000 0004] was declined
number [card 3400-0000-0000-009] has expired
her card [card 6011.0009.9013.9424] is new
the card [card 4012888888881881], issued in May
call [phone +1 (437) 555-0689] tonight
phone [phone +49 30 1234567] or write
ring [phone (415) 555-0199] after six
dial [phone 555-867-5309], ask for Jo
fax [phone +44.20.7946.0958] is off
my cell [phone +1 212 555 0187] is here
token = "[secret ffc3105535f423f352535e4ac53b5fefe076ac6d]" stays private
key : [secret 9b2d7c41e8f04a6db35c1e7f8a90d2c4] was leaked
secret=[secret a94a8fe5ccb19ba61c4c0873d391e987982fbbd3] in the file
password = "[secret Zx81kQ93mmP07vLs22]" must change
the old house stood by the river, and nobody came.
In 1999 about 250 people lived there; by 2024 it was 1,300.
see page 12 of part 3, section 4.2, for the table
it costs 19.99 or 20 in all, 5% less than before
version 2.10.3 came out on 2024-01-31 at 12:30:45
ONLY!! CAPITALS!! IN!! THIS!! LINE!! HERE!!
odd*** marks### behind%%% every&&& word$$$ here
| some | words | in | a | row |
https://www.example.org/en/page-12.html?page=2 has more
the range 10-20 and the ratio 3/4 are known
e.g. no. 7 (seven) and no. 11 (eleven) won 3:1
x = 5 and y = 12 give 60
Ein Satz über schöne Häuser, und noch ein Wort.
La niña vive en la calle 8, número 15.
Le café est ouvert de 8h à 22h30 tous les jours.
order 48213 of 3 items was sent on 5.6.2023
"""

TAGS = ("O", *(f"{place}-{kind}" for kind in KINDS for place in "BI"))
EDGE = "<edge>"  # the shape before the first and behind the last word


MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def trimmed(word: str) -> tuple[int, int]:
    """Where a word begins and ends without the marks around it; an opening plus sign or bracket of a number stays."""
    first, last = 0, len(word)
    while first < last and not word[first].isalnum() and not (word[first] in "+(" and word[first + 1 : first + 2].isdigit()):
        first += 1
    while last > first and not word[last - 1].isalnum() and not (word[last - 1] == ")" and "(" in word[first:last]):
        last -= 1
    return first, last


DIGITS, LETTERS, ANY = re.compile("[0-9]+"), re.compile(r"[^\W\d_]+"), re.compile(".", re.DOTALL)
MIXED = re.compile("(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}")


# Runs of a word that its shape spells out; what stands behind them is only summed up.
SPELLED = 16
# In place of the tag of a word with more runs, which is tagged in parts: what stands between these marks.
COMPOUND = -1
PART = re.compile(r"""[^\s,;"'{}&|<>]+""")


def shape(word: str) -> str:
    """A word with its letters and digits replaced by their kinds and rough lengths.

    Behind an ellipsis follows what the coarser views need to know of the runs that are not spelled out.
    """
    if word.isalpha():
        return "w"
    first, last = trimmed(word)
    core = word[first:last]
    if core.isalpha() or not core:
        return "w"
    parts = []
    at = 0
    while at < len(core):
        run = MIXED.match(core, at)
        if run:
            parts.append("M")
        elif run := DIGITS.match(core, at):
            n = len(run[0])
            parts.append("9" * n if n < 5 else "5" if n < 9 else "D" if n < 12 else "C" if n < 20 else "L")
        elif run := LETTERS.match(core, at):
            parts.append("a")
        else:
            run = ANY.match(core, at)
            parts.append(run[0] if run[0].isascii() else "~")
        at = run.end()
    spelled, rest = "".join(parts[:SPELLED]), "".join(parts[SPELLED:])
    if not rest:
        return spelled
    views = ["." * min(rest.count("."), 4), "9" * min(sum(c in "95DCL" for c in rest), 4)]
    views += [c for c in ("@", "C", "M") if c in rest] + ["(a" if "(a" in rest or "[a" in rest else "a" if "a" in rest else ""]
    return spelled + "…" + "".join(views)


def shape_features(form: str) -> list[str]:
    """What the field knows of a shape: itself and a few coarser views."""
    digits = sum(c in "95DCL" for c in form)
    return [
        f"is {form.partition('…')[0]}",
        f"at {'@' in form or '(a' in form or '[a' in form}",
        f"dots {min(form.count('.'), 4)} {digits > 0}",
        f"digits {min(digits, 4)} {'w' if 'a' in form else ''}",
        f"long {'C' in form} {'M' in form}",
        f"plus {form[:1] == '+'} {form[:1] == '('}",
    ]


def tokens_of(line: str) -> tuple[list[str], list[str]]:
    """The words of a labelled line and their tags."""
    words, tags = [], []
    text, spans, at = "", [], 0
    for mark in re.finditer(r"\[(" + "|".join(KINDS) + r") ((?:[^\[\]]|\[[a-z]+\])*)\]", line):
        text += line[at : mark.start()]
        spans.append((len(text), len(text) + len(mark[2]), mark[1]))
        text += mark[2]
        at = mark.end()
    text += line[at:]
    for word in WORD.finditer(text):
        inside = [(a, k) for a, b, k in spans if word.start() < b and word.end() > a]
        words.append(word[0])
        if not inside:
            tags.append("O")
        else:
            tags.append(("B-" if inside[0][0] >= word.start() else "I-") + inside[0][1])
    return words, tags


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of features (of the word before, the word, the word after) and of tag transitions."""

    PLACES = ("before ", "", "after ")

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(TAGS)))
        self.moves = np.zeros((len(TAGS) + 1, len(TAGS)))  # the last row is the start
        self._forbidden = np.zeros_like(self.moves)
        for a, before in enumerate((*TAGS, "start")):
            for b, tag in enumerate(TAGS):
                if tag[0] == "I" and before[2:] != tag[2:]:
                    self._forbidden[a, b] = -1e4

    def _features(self, forms: list[str], t: int) -> list[str]:
        around = [forms[t - 1] if t else EDGE, forms[t], forms[t + 1] if t + 1 < len(forms) else EDGE]
        return [place + f for place, form in zip(self.PLACES, around) for f in shape_features(form)]

    def fit(self, lines: list[tuple[list[str], list[str]]], rounds: int = 300, held_back: float = 0.02) -> Field:
        """Maximise the regularised likelihood by Adam; gradients by forward and backward sums over all lines at once."""
        tagged = [([shape(w) for w in words], [TAGS.index(t) for t in tags]) for words, tags in lines if words]
        longest = max(len(tags) for _, tags in tagged)
        rows = [[self._features(forms, t) for t in range(len(forms))] for forms, _ in tagged]
        for row in rows:
            for found in row:
                for f in found:
                    self.index.setdefault(f, len(self.index))
        n, k, width = len(rows), len(TAGS), len(rows[0][0])
        at = np.full((n, longest, width), len(self.index))
        gold = np.zeros((n, longest, k))
        real = np.zeros((n, longest), bool)
        for i, (row, (_, tags)) in enumerate(zip(rows, tagged)):
            for t, found in enumerate(row):
                at[i, t] = [self.index[f] for f in found]
                gold[i, t, tags[t]], real[i, t] = 1, True
        before = np.concatenate([np.zeros((n, 1, k)), gold[:, :-1]], axis=1)
        gold_moves = np.einsum("nta,ntb->ab", before, gold)
        gold_start = gold[:, 0].sum(axis=0)
        theta = np.zeros((len(self.index) + 1 + k + 1, k))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            weights, moves = theta[: len(self.index) + 1], theta[len(self.index) + 1 :] + self._forbidden
            emit = weights[at].sum(axis=2)
            alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            alpha[:, 0] = emit[:, 0] + moves[k]
            for t in range(1, longest):
                new = _log_sum(alpha[:, t - 1, :, None] + moves[None, :k], 1) + emit[:, t]
                alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = _log_sum(moves[None, :k] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(real[:, t + 1, None], new, 0)
            total = _log_sum(alpha[:, -1], 1)
            marginal = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
            gradient = np.zeros_like(theta)
            np.add.at(gradient, at.reshape(-1, width), (gold - marginal).reshape(-1, 1, k))
            pair = alpha[:, :-1, :, None] + moves[None, None, :k] + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]
            expected = (np.exp(pair) * real[:, 1:, None, None]).sum(axis=(0, 1))
            gradient[len(self.index) + 1 : -1] = gold_moves - expected
            gradient[-1] = gold_start - marginal[:, 0].sum(axis=0)
            gradient -= held_back * theta
            gradient[len(self.index)] = 0
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights = theta[: len(self.index)]
        self.moves = theta[len(self.index) + 1 :] + self._forbidden
        return self

    def emissions(self, form: str) -> np.ndarray:
        """(3, tags): what a shape adds to the word after it, to itself and to the word before it."""
        found = np.zeros((3, len(TAGS)))
        for p, place in enumerate(self.PLACES):
            for f in shape_features(form):
                at = self.index.get(place + f)
                if at is not None:
                    found[p] += self.weights[at]
        return found


def trained(table: str = LABELLED) -> Field:
    """The field of a labelled table, one line per example."""
    return Field().fit([tokens_of(line) for line in table.strip().splitlines() if line.strip()])


class Tagger:
    """Tags the words of whole batches of texts."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()
        k = len(TAGS)
        possible = field.moves[:k] > -1e3
        inner = np.where(possible, field.moves[:k], np.nan)
        # The most that transitions can favour any other tag over "O" at one word.
        self.reach = 2 * (np.nanmax(inner) - min(np.nanmin(inner[:, 0]), np.nanmin(inner[0]), field.moves[k, 0]))
        self.reach = max(self.reach, 0.0) + max(0.0, field.moves[k].max() - field.moves[k, 0])

    def forget(self) -> None:
        """Let go of all words and shapes, at the end of a task or when there are too many."""
        self.forms: dict[str, int] = {EDGE: 0}
        self.words: dict[str, int] = {}
        self.emit = self.field.emissions(EDGE)[None]
        self.compound = np.zeros(1, bool)

    def _form(self, word: str) -> int:
        form = shape(word)
        number = self.forms.get(form)
        if number is None:
            number = self.forms[form] = len(self.forms)
            self.emit = np.concatenate([self.emit, self.field.emissions(form)[None]])
            self.compound = np.append(self.compound, "…" in form)
        return number

    def tags(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(tags, offsets)``: a tag number, or :data:`COMPOUND`, per word of all texts, and where the words of each text begin."""
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))  # untrimmed ends would give empty words
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        if len(self.words) > 200_000 or len(self.forms) > 20_000:
            self.forget()
        known, plain = self.words, self._form("a")
        numbers = []
        for word in coded.dictionary.to_pylist():
            number = known.get(word)
            if number is None:
                number = known[word] = plain if word.strip(MARKS).isalpha() else self._form(word)
            numbers.append(number)
        form = np.array(numbers, np.int64)[coded.indices.to_numpy()] if numbers else np.zeros(0, np.int64)
        tags = np.zeros(len(form), np.int64)
        # How much each place favours "O" over the best other tag, at least, added up per word.
        margin = self.emit[:, :, 0] - self.emit[:, :, 1:].max(axis=2)
        left, right = np.zeros_like(form), np.zeros_like(form)
        left[1:], right[:-1] = form[:-1], form[1:]
        full = np.diff(offsets) > 0
        left[offsets[:-1][full]] = right[offsets[1:][full] - 1] = 0
        sure = margin[form, 1] + margin[left, 0] + margin[right, 2]
        open_words = np.flatnonzero(sure <= self.reach)
        if not len(open_words):
            tags[self.compound[form]] = COMPOUND
            return tags, offsets
        owner = np.searchsorted(offsets, open_words, "right") - 1
        emit = self.emit[left[open_words], 0] + self.emit[form[open_words], 1] + self.emit[right[open_words], 2]
        fresh = np.ones(len(open_words), bool)
        fresh[1:] = (np.diff(open_words) != 1) | (np.diff(owner) != 0)
        starts = np.flatnonzero(fresh)
        lengths = np.diff(np.append(starts, len(open_words)))
        opening = open_words[starts] == offsets[owner[starts]]
        closing = open_words[starts + lengths - 1] + 1 == offsets[owner[starts] + 1]
        found = np.zeros(len(open_words), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            for first in range(0, len(own), 4096):
                part = own[first : first + 4096]
                rows = starts[part][:, None] + np.arange(length)
                found[rows] = self._viterbi(emit[rows], opening[part], closing[part])
        tags[open_words] = found
        tags[self.compound[form]] = COMPOUND
        return tags, offsets

    def _viterbi(self, emit: np.ndarray, opening: np.ndarray, closing: np.ndarray) -> np.ndarray:
        """The best tags of runs of one length; a run begins behind "O" or the start, and ends before "O" or the end."""
        n, length, k = emit.shape
        moves = self.field.moves
        best = emit[:, 0] + np.where(opening[:, None], moves[k], moves[0])
        back = np.zeros((n, length, k), np.int64)
        for t in range(1, length):
            paths = best[:, :, None] + moves[None, :k]
            back[:, t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + emit[:, t]
        best = best + np.where(closing[:, None], 0.0, moves[:k, 0])
        out = np.zeros((n, length), np.int64)
        out[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out


def luhn(digits: str) -> bool:
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plausible(kind: str, text: str) -> bool:
    """The check a number must pass; other kinds have none."""
    digits = _digits(text)
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in DIGITS.findall(text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses, leftmost first: the run before each ``@``, if a domain follows. Linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the plain forms, by start and then kind; failing matches are dropped."""
    spans = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            if kind != "phone" or "+" in text:
                spans += [(*m.span(), kind) for m in pattern.finditer(text) if plausible(kind, m[0])]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def marked_spans(text: str, words: Iterable[tuple[int, int]], tags: Iterable[int]) -> list[tuple[int, int, str]]:
    """The spans that the tags of a text's words mark, without the marks around them."""
    spans: list[tuple[int, int, str]] = []
    going = ""
    for tag, (begin, finish) in zip(tags, words):
        name = TAGS[tag]
        if name == "O":
            going = ""
            continue
        first, last = trimmed(text[begin:finish])
        start, end = begin + first, begin + last
        if name[0] == "I" and going == name[2:] and spans:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]), going)
        elif start < end:
            spans.append((start, end, name[2:]))
        going = name[2:]
    return [s for s in spans if plausible(s[2], text[s[0] : s[1]])]


def field_spans(text: str, tags: list[int], own: Tagger) -> list[tuple[int, int, str]]:
    """The spans of a text by the tags of its words. Words of very many runs, such as JSON, are tagged again in parts."""
    words = [word.span() for word in WORD.finditer(text)]
    long = [i for i, tag in enumerate(tags[: len(words)]) if tag == COMPOUND]
    spans = marked_spans(text, words, [0 if tag == COMPOUND else tag for tag in tags])
    for i in long:
        parts = [part.span() for part in PART.finditer(text, *words[i])]
        if parts:
            found, _ = own.tags(pa.array([" ".join(text[a:b] for a, b in parts)]))
            spans += marked_spans(text, parts, [0 if tag == COMPOUND else tag for tag in found.tolist()])
    return sorted(spans)


def added(base: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """All base spans, and those others that touch none of them."""
    free = [s for s in more if not any(s[0] < b and s[1] > a for a, b, _ in base)]
    return sorted(base + free, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


@lru_cache(maxsize=2)
def tagger(table: str = LABELLED) -> Tagger:
    """One trained tagger per worker and table. Training is repeatable: no random numbers."""
    return Tagger(trained(table))


def _spans(texts: pa.Array, table: str) -> Iterator[tuple[str, list, list]]:
    """Text, base spans and all spans of each text of a batch."""
    texts = pc.fill_null(texts, "")
    tags, offsets = tagger(table).tags(texts)
    marked = np.add.reduceat(np.append(tags != 0, False), offsets[:-1]) if len(texts) else []
    marked = np.where(np.diff(offsets) > 0, marked, 0) if len(texts) else []
    for at, text in enumerate(texts.to_pylist()):
        base = base_spans(text)
        own = field_spans(text, tags[offsets[at] : offsets[at + 1]].tolist(), tagger(table)) if marked[at] else []
        yield text, base, added(base, own)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", table: str = LABELLED) -> DataFrame:
    """``(key, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every whole text.

    The counts and ``base_sha256`` are of the plain forms, ``spans`` lists all as ``kind:start:end``, in code
    points. A NULL text is empty and has none. Rows that repeat are searched alike; no row is moved.
    """
    rows = pick(docs, **{key: key, "_text": text})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            digests, lists = [], []
            for _, base, spans in _spans(batch.column(1), table):
                for kind, column in zip(BASE_KINDS, counts):
                    column.append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(spans))
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts]]
            columns += [pa.array(digests, pa.string()), pa.array(lists, pa.string())]
            names = [key, *[f"n_{kind}" for kind in BASE_KINDS], "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)
        tagger(table).forget()

    kind = rows.schema[key].dataType.simpleString()
    numbers = ", ".join(f"n_{kind} bigint" for kind in BASE_KINDS)
    return rows.mapInArrow(run, f"`{key}` {kind}, {numbers}, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``<KIND>`` in place of each span; spans that overlap become one, named after the first."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text", table: str = LABELLED, length: str | None = None) -> DataFrame:
    """``docs`` with all personal data masked in ``text``; other columns, and NULL texts, stay as they are.

    A column ``length``, if there is one, is set to the characters of the new text.
    """
    bounded(docs.sparkSession)
    names, numbered = docs.columns, docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    place = names.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, place):
            clean = [masked(value, spans) for value, _, spans in _spans(batch.column(place), table)]
            new = pc.if_else(batch.column(place).is_null(), pa.scalar(None, pa.string()), pa.array(clean, pa.string()))
            columns = list(batch.columns)
            columns[place] = new
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
        tagger(table).forget()

    found = numbered.mapInArrow(run, numbered.schema)
    if length in names:
        own = f"_{names.index(length)}"
        found = found.withColumn(own, F.length(f"_{place}").cast(found.schema[own].dataType))
    return found.toDF(*names)
