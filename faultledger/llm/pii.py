"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns are the base and always stay. The field reads a text as a chain of
words, each described by its shape (digits, letters, dots, hyphens and so on), and
gives every word a label; labelled runs that touch no base span are added. It is
trained here, on a small labelled table, by gradient ascent on the likelihood, and
decoded by Viterbi over numpy batches of chains.

A word without digits, ``@`` and ``+`` has one shape, *plain*. Where the trained
weights put label O so far ahead for it that no transitions can make up for that
(checked, not assumed), the best path surely has O there, so the chain falls apart
at plain words and only the islands between them are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger.llm.shared import quoted, schema_with, without

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Bytes of text that are read at once.
SLAB = 1_000_000

DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A match takes a run of digits whole, so none starts inside a run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: The labelled table: [kind text] marks a span of words.
LABELLED = """
please write to [email ann.lee@post.example.org] before friday
contact: [email sales@shop-online.example.com] or the front desk
the owner [email j_marsh+news@host.example.net] replied at once
send it to [email k%dept@a.example.co], not to me
mail [email rob(at)mail7.example.com] for the draft
she wrote from [email li.wei@@mail.example.net] in march
the @ sign and the word @home are no address
follow @reader or @daily_news for more
prices @ 3 each, lots @ 20 each
the server at [ip 10.20.30.40] did not answer
ping [ip 192.168.7.1] and [ip 172.16.254.9] from the lab
blocked: [ip 8.8.4.4], then [ip 100.64.0.12].
version 1.2.3 is out, 1.2.4 follows in may
see section 4.5.6.1.2 and table 3.1 of the report
release 10.4 replaces 10.3.2 on all hosts
host [ip 203.0.113.77:8080] was slow today
paid with card [card 4539578763621486] on monday
the number [card 5500-0055-5555-5559] was refused
card [card 4111 1111 1111 1111] expires in may
charge [card 3782 822463 10005] for the room
old card [card 6011 0009 9013 9424] and new card [card 4000056655665556]
refund to [card 4929-1234-5678-9012] please
call [phone +1 (202) 555-0143] today
call [phone +44 20 7946 0958] after nine
ring [phone +49 30 901820] or come by
our desk is at [phone (415) 555-2671] until five
text [phone 415-555-2671] or [phone 212-555-0199] now
phone [phone 020 7946 0321] for a table
my number is [phone (303) 555-0111] and his is [phone +33 1 42 68 53 00]
fax [phone 555-0134-889] was busy
in 1998 and 2004 there were 12 of them
the years 1914 1918 and 1939 were hard
it costs 1,200 or 1.5 million at 3.5 percent
order 20418 of 2023-05-17 has 3 parts
at 10:30 on 12/08/2021 the train left
room 101 on floor 12 has 4 beds
chapter 3 verse 16 and page 220
scores of 3-2 and 10-7 were seen
isbn 978-3-16-148410-0 is out of print
key 24be64439e3e49cf46b2d7c90f3602a3 leaked
token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
password=b7db7aa4a5fcc78305 was changed
id AKIA9Q2Z7RT0LM4X is disabled
sha 2cf24dba5fb0a30e26e83b2ac5b9e29e and 7d865e959b2466918c9863afca942d0f
c++ and a+b are not numbers, nor is +5
it rose by +3.5 to 14.2 and fell by -7
there are 7,000,000,000 people and 195 states
serial 00012345678901234567890123 is on the back
the sum 1 + 2 + 3 is 6
words only here, and nothing else to see
"""

#: Classes of bytes for the shapes.
CLASSES = np.full(256, 5, np.uint8)
CLASSES[48:58] = 0
CLASSES[65:91] = CLASSES[97:123] = CLASSES[128:] = 1
for _byte, _class in zip(b".-@+()", (2, 3, 4, 6, 7, 7), strict=True):
    CLASSES[_byte] = _class
#: White space, and the bytes that make a word other than plain.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
MARKED = np.zeros(256, bool)
MARKED[[*range(48, 58), 64, 43]] = True
#: How many values each feature has; the last row of weights is the plain word's.
SIZES = (10, 3, 2, 5, 5, 8, 3, 2)
OFFSETS = np.cumsum([0, *SIZES[:-1]])
PLAIN = sum(SIZES)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of weights that each marked word uses, one per feature."""
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    kinds = CLASSES[data[np.repeat(starts - first, lengths) + np.arange(lengths.sum())]]
    counts = [np.add.reduceat((kinds == c).astype(np.int32), first) for c in range(8)]
    digits, letters, dots, hyphens, ats, others, _, parens = counts
    features = (
        np.searchsorted([1, 2, 4, 5, 7, 9, 12, 16, 20], digits, "right"),
        np.searchsorted([1, 3], letters, "right"),
        np.minimum(ats, 1),
        np.minimum(dots, 4),
        np.minimum(hyphens, 4),
        kinds[first],
        np.minimum(others, 2),
        np.minimum(parens, 1),
    )
    return np.stack(features, axis=1) + OFFSETS


@dataclass
class Field:
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[rows].sum(axis=1)

    @property
    def plain_is_outside(self) -> bool:
        """Whether O at a plain word beats any label there, whatever stands beside it."""
        plain, moves = self.weights[PLAIN], self.moves
        into = np.minimum((moves[:, :1] - moves).min(axis=0), 0)
        out = np.minimum((moves[:1] - moves).min(axis=1), 0)
        return bool((plain[0] - plain[1:] + into[1:] + out[1:] > 0).all())

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of chains of one length: scores are chains x words x labels."""
        n, length, _ = scores.shape
        back = np.zeros(scores.shape, np.int8)
        best = scores[:, 0]
        for t in range(1, length):
            options = best[:, :, None] + self.moves
            back[:, t] = options.argmax(axis=1)
            best = options.max(axis=1) + scores[:, t]
        out = np.zeros((n, length), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    blank = BLANK[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(MARKED[data], dtype=np.int32)])
    return seen[ends] > seen[starts]


def parse(line: str) -> tuple[str, list[int]]:
    """The text of a line of the labelled table and the label of each of its words."""
    text, labels = "", []
    for plain, kind, inside in re.findall(r"([^\[]+)|\[(\w+) ([^\]]+)\]\S*", line.strip()):
        part = plain or inside
        text += part if text.endswith(" ") or not text or part.startswith(" ") else f" {part}"
        labels += [LABELS.index(kind) if kind else 0] * len(part.split())
    return text, labels


@lru_cache(maxsize=4)
def train(table: str = LABELLED, rounds: int = 300, rate: float = 0.5, ridge: float = 0.003, move_ridge: float = 0.5) -> Field:
    """Maximum likelihood with a ridge on the weights and one on the moves, by full-batch Adagrad.

    The plain word's weights have none: that they can be told apart is the point.
    """
    chains = []
    for line in filter(str.strip, table.splitlines()):
        text, labels = parse(line)
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends = words(data)
        marked = _marked(data, starts, ends)
        use = np.zeros((len(starts), PLAIN + 1))
        use[~marked, PLAIN] = 1
        if marked.any():
            np.put_along_axis(rows := np.zeros((int(marked.sum()), PLAIN + 1)), shapes(data, starts[marked], ends[marked]), 1, axis=1)
            use[marked] = rows
        chains.append((use, np.array(labels)))
    weights, moves = np.zeros((PLAIN + 1, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    steps = [np.full(weights.shape, 1e-6), np.full(moves.shape, 1e-6)]
    for _ in range(rounds):
        slope, slope_moves = -ridge * weights, -move_ridge * moves
        slope[PLAIN] = 0
        for use, labels in chains:
            scores = use @ weights
            ahead, behind = np.zeros(scores.shape), np.zeros(scores.shape)
            ahead[0] = scores[0]
            for t in range(1, len(scores)):
                ahead[t] = scores[t] + _logsum(ahead[t - 1][:, None] + moves, 0)
            for t in range(len(scores) - 2, -1, -1):
                behind[t] = _logsum(moves + (scores[t + 1] + behind[t + 1])[None], 1)
            total = _logsum(ahead[-1], 0)
            gap = np.eye(len(LABELS))[labels] - np.exp(ahead + behind - total)
            slope += use.T @ gap
            for t in range(1, len(scores)):
                slope_moves -= np.exp(ahead[t - 1][:, None] + moves + scores[t] + behind[t] - total)
                slope_moves[labels[t - 1], labels[t]] += 1
        for value, change, past in ((weights, slope, steps[0]), (moves, slope_moves, steps[1])):
            past += change**2
            value += rate * change / np.sqrt(past)
    return Field(weights, moves)


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis)
    return top + np.log(np.exp(values - np.expand_dims(top, axis)).sum(axis=axis))


def label_islands(field: Field, data: np.ndarray, breaks: np.ndarray) -> list[tuple[str, int, int]]:
    """kind, start, end in bytes of what the field labels; chains end at ``breaks``."""
    starts, ends = words(data)
    marked = _marked(data, starts, ends)
    split = field.plain_is_outside
    chosen = np.flatnonzero(marked) if split else np.arange(len(starts))
    if not len(chosen):
        return []
    scores = np.zeros((len(chosen), len(LABELS)))
    scores[:] = field.weights[PLAIN]
    hot = marked[chosen]
    if hot.any():
        scores[hot] = field.emissions(shapes(data, starts[chosen[hot]], ends[chosen[hot]]))
    # the first word after each start of a text, and whether a plain word stands before and after an island
    opens = np.searchsorted(starts, np.concatenate([[0], breaks]))
    text_of = np.searchsorted(opens, chosen, "right")
    new = np.concatenate([[True], (np.diff(chosen) > 1) | (np.diff(text_of) > 0)])
    heads = np.flatnonzero(new)
    lengths = np.diff([*heads, len(chosen)])
    tails = heads + lengths - 1
    if split:
        scores[heads] += np.where(np.isin(chosen[heads], opens)[:, None], 0, field.moves[0])
        scores[tails] += np.where(np.isin(chosen[tails] + 1, opens)[:, None], 0, field.moves[:, 0])
    labels = np.zeros(len(chosen), np.int8)
    for length in np.unique(lengths):
        at = heads[lengths == length][:, None] + np.arange(length)
        labels[at] = field.viterbi(scores[at])
    several = (labels == LABELS.index("card")) | (labels == LABELS.index("phone"))
    joined = ~new & (labels == np.concatenate([[0], labels[:-1]])) & several
    firsts = np.flatnonzero(~joined)
    lasts = np.append(firsts[1:], len(chosen)) - 1
    kept = labels[firsts] > 0
    return [(LABELS[labels[a]], int(starts[chosen[a]]), int(ends[chosen[b]])) for a, b in zip(firsts[kept], lasts[kept], strict=True)]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them from the left, without trying each start of a long run."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [sum(divmod(2 * v, 10)) for v in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points) of the fixed patterns, by start and kind."""
    out = [("email", a, b) for a, b in emails(text)]
    first = DIGIT.search(text)
    if first:
        for m in IP.finditer(text, first.start()):
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text, first.start()):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda span: (span[1], KINDS.index(span[0])))


#: What a labelled span leaves out at its ends.
TRIM = "\"'.,;:!?<>[]{}=#$%&*|"


def all_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """kind, start, end, base of each text's spans, by start and kind."""
    out: list[list[tuple[str, int, int, bool]]] = []
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at]) <= SLAB):
            part.append(texts[at])
            size += len(texts[at])
            at += 1
        out += _spans_of(part, field)
    return out


def _spans_of(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    encoded = [text.encode() for text in texts]
    offsets = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    found: dict[int, list[tuple[str, int, int]]] = {}
    for kind, start, end in label_islands(field, data, offsets[1:]):
        found.setdefault(int(np.searchsorted(offsets, start, "right")) - 1, []).append((kind, start, end))
    out = []
    for number, text in enumerate(texts):
        base = base_spans(text)
        spans = [(*span, True) for span in base]
        if number in found:
            inside = data[offsets[number] : offsets[number + 1] - 1]
            points = np.concatenate([[0], np.cumsum((inside & 0xC0) != 0x80)])
            taken = np.array([[a, b] for _, a, b in base], np.int64).reshape(-1, 2)
            for kind, start, end in found[number]:
                a, b = int(points[start - offsets[number]]), int(points[end - offsets[number]])
                while a < b and text[a] in TRIM:
                    a += 1
                while b > a and text[b - 1] in TRIM:
                    b -= 1
                if a < b and not ((taken[:, 0] < b) & (taken[:, 1] > a)).any():
                    spans.append((kind, a, b, False))
            spans.sort(key=lambda span: (span[1], KINDS.index(span[0])))
        out.append(spans)
    return out


SPAN = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()),
])


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii", field: Field | None = None) -> DataFrame:
    """Add an array of kind, start, end (code points, end exclusive) and base of all spans.

    The whole text is read; null and empty texts have none. ``base`` tells the fixed
    patterns from what the field adds; an added span touches no base span. All
    columns stay but one that is called ``out``; repeated rows stay repeated.
    """
    docs = without(docs, out)
    spread = docs.sparkSession.sparkContext.broadcast(field or train())
    schema = schema_with(docs, (out, T.ArrayType(SPAN, False)))
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans([value or "" for value in batch.column(at).to_pylist()], spread.value)
            spans = [[dict(zip(("kind", "start", "end", "base"), span, strict=True)) for span in one] for one in found]
            yield pa.record_batch([*batch.columns, pa.array(spans, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """``text`` with every span of ``pii`` replaced by its kind in angle brackets.

    Spans that overlap become one, named by the first. A null text stays null.
    """
    merged = F.aggregate(
        F.sort_array(F.transform(quoted(pii), lambda s: F.struct(s["start"], s["end"], s["kind"]))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["done"].alias("done"))).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["done"], F.substring(quoted(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("done"),
            )
        ),
        lambda acc: F.concat(acc["done"], F.substring(quoted(text), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return docs.withColumn(text, F.when(F.size(quoted(pii)) > 0, merged).otherwise(quoted(text)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
