"""Secret scans by character Markov models.

A candidate is a run of at least 16 letters, digits and ``+ / _ -``, with ``=`` padding. Two second-order Markov models over
its characters, one of random strings and one of ordinary identifiers, give a log-likelihood ratio, and a candidate is a
secret where the ratio exceeds a threshold. Both are trained from labelled samples: generated keys of the common encodings,
labelled random, and identifiers, paths, numbers and dates made from a word list, labelled ordinary, to which the words of all
documents are added, so that the languages of the corpus count as ordinary. The threshold is set on a held-out half of the
samples and of the corpus. Words of the corpus come to the driver as sums of trigrams and of ratios only, whose size is fixed.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text import buffers

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PLACEHOLDER = "[SECRET]"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_S = len(_ALPHABET) + 1  # 0 stands before the first character
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(1, _S)
_WORDS = (
    "access account action active address after agent alias allow amount api app archive array async attribute auth available back base batch before begin bind block body boolean border bottom box branch "
    "bridge browser buffer build bundle byte cache call cancel capture card category center change channel character check child class clean clear client clock close cluster code collect color column command "
    "comment commit common compare complete component compute condition config connect console constant container content context control convert copy core count create current cursor custom data database "
    "date debug decode default define delete depth description detail device dialog digest directory disable dispatch display distance document domain double download draw drive driver dynamic edge edit "
    "element email empty enable encode encoding end engine entity entry environment error escape event exception execute exist expand expect export expression extension external factory fail feature fetch "
    "field file filter final find first flag float flush folder font force format forward frame framework from function generate global graph group handle handler hash header height hidden history host "
    "icon identifier image implement import include index info initial inner input insert install instance integer interface internal interval invalid item iterator join json keyboard label language last "
    "layer layout left length level library limit line link list listener load local location lock log login logger lookup machine main manager map margin mask master match matrix maximum media member "
    "memory menu merge message metadata method metric middle minimum mobile mode model module monitor mouse move multiple name namespace native network next node normal notification null number object "
    "offset open operation operator option order origin output overlay owner package padding page panel parameter parent parse partition password path pattern payload pending permission persist phone pixel "
    "platform player plugin point policy pool popup port position prefix prepare preview previous print priority private process processor product profile program progress project property protocol provider "
    "proxy public publish query queue random range read ready record reference refresh region register release remote remove render replace report repository request require reset resolve resource response "
    "result retry return reverse right role root rotate router row rule runtime sample save scale schedule schema scope screen script scroll search second section security segment select selector send "
    "sequence serial server service session setting setup shadow shape share shell shift show signal signature simple single size source space split stack stage standard start state static status storage "
    "store stream string structure style submit subscribe success suffix summary support switch symbol sync syntax system table target task template temporary terminal test text theme thread threshold time "
    "timeout timestamp title toggle token toolbar topic total trace track transaction transfer transform transition translate tree trigger type unique unit update upgrade upload user utility valid validate "
    "value variable vector vendor verify version video view virtual visible visitor volume wait warning watch weight widget width window word worker wrapper write zone"
).split()


class Model(NamedTuple):
    ratio: np.ndarray
    threshold: float

    def llr(self, candidates: list[str]) -> np.ndarray:
        if not candidates:
            return np.zeros(0)
        context, size = _contexts(candidates)
        return np.add.reduceat(self.ratio[context], np.concatenate([[0], np.cumsum(size)[:-1]]))


def _contexts(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram of each character with the two before it, and the sizes."""
    size = np.array([len(s) for s in strings])
    c = _CODE[np.frombuffer("".join(strings).encode("ascii"), np.uint8)]
    place = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    one = np.where(place > 0, np.roll(c, 1), 0)
    two = np.where(place > 1, np.roll(c, 2), 0)
    return (two * _S + one) * _S + c, size


def labelled(n: int = 6000, seed: int = 5) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers)"""
    r = random.Random(seed)
    draw = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = [
        lambda k: draw("0123456789abcdef", k), lambda k: draw("0123456789abcdef", k), lambda k: draw("0123456789ABCDEF", k), lambda k: draw(upper + digits, k), lambda k: draw(upper + "234567", k),
        lambda k: draw(lower + digits, k), lambda k: draw(upper + lower + digits, k), lambda k: draw(upper + lower + digits, k), lambda k: base64.b64encode(r.randbytes(k * 3 // 4)).decode(), lambda k: base64.urlsafe_b64encode(r.randbytes(k * 3 // 4)).decode(),
    ]
    prefixes = ["", "", "", "", "AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "AIza", "glpat-", "key-"]
    secret = []
    while len(secret) < n:
        s = r.choice(prefixes) + r.choice(kinds)(r.choice([16, 18, 20, 20, 24, 32, 32, 40, 40, 48, 64]))
        secret.append(s)

    def words(k: int) -> list[str]:
        return [r.choice(_WORDS) for _ in range(k)]

    def number() -> str:
        return draw(digits, r.randint(1, 4))

    ordinary = []
    while len(ordinary) < n:
        w = words(r.randint(2, 6))
        kind = r.randrange(9)
        s = [
            lambda: "_".join(w), lambda: "-".join(w), lambda: "_".join(w).upper(), lambda: w[0] + "".join(x.title() for x in w[1:]), lambda: "".join(x.title() for x in w), lambda: "/".join(w),
            lambda: "".join(w), lambda: "-".join([*w, number()]), lambda: r.choice([f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", "/".join([w[0], number(), number(), w[1]]), draw(digits, r.randint(16, 24)), f"v{number()}-{number()}-{w[0]}-{w[1]}", r.choice("-_=+/0aAxX") * r.randint(16, 60)]),
        ][kind]()
        ordinary.append(s if len(s) >= 16 else s + "-" + "-".join(words(3)))
    return secret, ordinary


def _counts(strings: list[str]) -> np.ndarray:
    own = [s for s in strings if s]
    return np.bincount(_contexts(own)[0], minlength=_S**3).astype(float) if own else np.zeros(_S**3)


def _ratio(secret: np.ndarray, ordinary: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """Log ratios from the trigram counts of both kinds."""
    tables = []
    for count in (secret, ordinary):
        three = count.reshape(_S, _S, _S)
        two = three.sum(0)
        one = (two.sum(0) + 0.5) / (two.sum() + 0.5 * _S)
        p2 = (two + 8 * one) / (two.sum(1, keepdims=True) + 8)
        tables.append(np.log((three + 8 * weight * p2) / (three.sum(2, keepdims=True) + 8 * weight)))
    return (tables[0] - tables[1]).ravel()


def _threshold(good: np.ndarray, times: np.ndarray, bad: np.ndarray) -> float:
    """Between what all but one in a thousand ordinary strings stay below and the weakest secrets, but never below even odds; times: how often each good ratio is."""
    order, bad = np.argsort(good, kind="stable"), np.sort(bad)
    reach = np.cumsum(times[order])
    top = good[order][min(len(good) - 1, int(np.searchsorted(reach, 0.999 * reach[-1], side="right")))]
    low = bad[int(len(bad) * 0.01)]
    return float(max(0.0, top if low <= top else (top + low) / 2))


def fit(corpus_words: list[str], seed: int = 5, weight: float = 1.0) -> Model:
    """Models and threshold from the labelled samples and ordinary words of the corpus; the latter count as ordinary however short."""
    secret, ordinary = labelled(seed=seed)
    joined = [a + b for a, b in zip(corpus_words[0::2], corpus_words[1::2]) if len(a + b) >= 16]  # words as long as candidates
    model = Model(_ratio(_counts(secret[0::2]), _counts(ordinary[0::2] + joined[0::2] + corpus_words), weight), 0.0)
    good = model.llr([s for s in ordinary[1::2] + joined[1::2] if CANDIDATE.fullmatch(s)])
    return model._replace(threshold=_threshold(good, np.ones(len(good)), model.llr(secret[1::2])))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: Beside these, letters are part of a longer string, often of a secret, which must not teach its own trigrams as ordinary.
_JOINT = np.zeros(256, bool)
_JOINT[np.frombuffer(b"0123456789+=", np.uint8)] = True
#: What candidates are made of: a run of 16 or more with a digit or + may be a secret, and none of its letters are words.
_RUN = _LETTER.copy()
_RUN[np.frombuffer(b"0123456789+/_-", np.uint8)] = True
#: Ratios of held-out strings of the corpus are counted in steps of 1 / _LEVELS; those below 0, which no threshold is, as one.
_LEVELS, _MOST = 64, 1 << 16


def _plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of 4 letters or more of a column that no digit, + or = adjoins and that are in no candidate with a digit or +, one behind the other: (codes, where words begin, begin and end of the pairs as long as candidates, which of these are held out).

    A pair is every other word of a text with the next; every other pair of a text is held out.
    """
    data, rows = buffers(column)
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    start = np.flatnonzero(letter & (~np.concatenate([[False], letter[:-1]]) | edge[:-1]))
    end = np.flatnonzero(letter & (~np.concatenate([letter[1:], [False]]) | edge[1:])) + 1
    joint = _JOINT[data]
    after = np.concatenate([joint, [False]])[end] & ~edge[end]
    long = (end - start >= 4) & ~after & ~(np.concatenate([[False], joint])[start] & ~edge[start])
    run = _RUN[data]
    first = np.flatnonzero(run & (~np.concatenate([[False], run[:-1]]) | edge[:-1]))
    last = np.flatnonzero(run & (~np.concatenate([run[1:], [False]]) | edge[1:])) + 1
    mixed = np.concatenate([[0], np.cumsum(joint)])
    may = (last - first >= 16) & (mixed[last] > mixed[first])
    long &= ~may[np.searchsorted(first, start, side="right") - 1] if len(first) else True
    start, size = start[long], (end - start)[long]
    at = np.concatenate([[0], np.cumsum(size)])
    codes = _CODE[data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]]
    doc = np.searchsorted(start, rows)
    place = np.arange(len(start)) - np.repeat(doc[:-1], np.diff(doc))
    last = np.zeros(len(start), bool)
    last[doc[1:][np.diff(doc) > 0] - 1] = True
    first = np.flatnonzero((place % 2 == 0) & ~last)
    first = first[at[first + 2] - at[first] >= 16]
    return codes, at[:-1], at[first], at[first + 2], place[first] // 2 % 2 == 1


def _trigrams(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The trigram at each character of strings that begin at start, of 2 characters at least."""
    one, two = np.roll(codes, 1), np.roll(codes, 2)
    one[start] = two[start] = two[start + 1] = 0
    return (two * _S + one) * _S + codes


def _inside(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def train(docs: DataFrame, *, mass: int = 80_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Models for docs: the words of 4 letters or more of all documents are ordinary, each as often as it is there.

    All words together weigh as much as ``mass`` words beside the labelled samples, or their own number if they are fewer, in the
    model as in the threshold, so neither depends on the size of the corpus. Rows without an id and null texts are left out; rows
    that repeat count each; very long texts are read whole; of an empty table the labelled samples alone make the models.
    """
    source = common.texts(docs, id_col, text_col)

    def summed(own, schema: str = "k int, n long") -> dict[int, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(0, np.int64)
            for batch in batches:
                for part in common.slices(batch, "text"):
                    n = own(part.column("text"))
                    total = n + np.pad(total, (0, len(n) - len(total))) if len(n) > len(total) else total + np.pad(n, (0, len(total) - len(n)))
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["k", "n"])

        found = source.mapInArrow(run, schema).groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        return dict(zip(found.column("k").to_pylist(), found.column("n").to_pylist()))

    def trigrams(column: pa.Array) -> np.ndarray:
        codes, start, begin, end, held = _plain(column)
        n = np.bincount(_trigrams(codes, start), minlength=_S**3 + 1) + np.bincount(_trigrams(codes, begin)[_inside(begin[~held], end[~held])], minlength=_S**3 + 1)
        n[_S**3] = len(start)
        return n

    count = np.zeros(_S**3 + 1)
    for k, n in summed(trigrams).items():
        count[k] = n
    share = min(1.0, mass / max(1.0, count[-1]))
    secret, ordinary = labelled()
    model = Model(_ratio(_counts(secret[0::2]), _counts(ordinary[0::2]) + share * count[:-1]), 0.0)

    def levels(column: pa.Array) -> np.ndarray:
        codes, _, begin, end, held = _plain(column)
        begin, size = begin[held], (end - begin)[held]
        if not len(begin):
            return np.zeros(0, np.int64)
        llr = np.add.reduceat(model.ratio[_trigrams(codes, begin)[_inside(begin, begin + size)]], np.cumsum(size) - size)
        return np.bincount(np.clip(np.floor(llr * _LEVELS) + 1, 0, _MOST).astype(np.int64))

    found = summed(levels)
    good = model.llr([s for s in ordinary[1::2] if CANDIDATE.fullmatch(s)])
    times = np.concatenate([np.ones(len(good)), share * np.array(list(found.values()), float)])
    good = np.concatenate([good, np.array(list(found), float) / _LEVELS])
    return model._replace(threshold=_threshold(good, times, model.llr(secret[1::2])))


def _scan(column: pa.Array, model: Model) -> tuple[list[int], list[int], list[int], np.ndarray]:
    row, start, end, text = [], [], [], []
    for k, t in enumerate(column.to_pylist()):
        if t:
            for m in CANDIDATE.finditer(t):
                row.append(k)
                start.append(m.start())
                end.append(m.end())
                text.append(m.group())
    return row, start, end, model.llr(text)


def secrets(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start and end in characters, and llr of each secret; the secret itself is not given.

    Null and empty texts have none; very long texts are read whole; a ratio equal to the threshold is none; rows that repeat, or
    share an id, give theirs each; rows without an id are skipped; an empty table gives no rows; other columns are not read.
    """

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, end, llr = _scan(batch.column("text"), model)
        hit = np.flatnonzero(llr > model.threshold)
        pick = lambda x: pa.array(np.asarray(x, np.int64)[hit])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick(row)), pick(start), pick(end), pa.array(np.round(llr[hit], 6))], ["doc_id", "start", "end", "llr"])

    return common.texts(docs, id_col, text_col).mapInArrow(common.over_slices(find), "doc_id long, start long, end long, llr double")


def redact(docs: DataFrame, model: Model, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with :data:`PLACEHOLDER` for each secret, in the columns of docs; length_col, if there is one, is set anew where a text changes.

    Every row stays: null and empty texts as they are, rows without an id, and rows that repeat, like others. Very long texts are
    read whole; an empty table gives no rows; other columns, whatever their names, are passed on.
    """
    names = docs.columns
    t, size = names.index(text_col), names.index(length_col) if length_col in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, t):
                row, start, end, llr = _scan(part.column(t), model)
                hits = np.flatnonzero(llr > model.threshold)
                if not len(hits):
                    yield part
                    continue
                text = part.column(t).to_pylist()
                length = part.column(size).to_pylist() if size is not None else None
                for h in hits[::-1]:  # from the end of each text
                    k = row[h]
                    text[k] = text[k][: start[h]] + PLACEHOLDER + text[k][end[h] :]
                    if length is not None:
                        length[k] = len(text[k])
                arrays = list(part.columns)
                arrays[t] = pa.array(text, part.column(t).type)
                if length is not None:
                    arrays[size] = pa.array(length, part.column(size).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(clean, docs.schema)
