"""Token counts of sections by offsets: each document is encoded once and its tokens are joined with the sections' spans.

Sections are the parts of a text between line breaks (``section`` counts from 0). The intervals of tokens and sections are
joined by their sorted ends. A token that crosses boundaries counts where the rule says:

* ``"first"``: the section of its first byte;
* ``"most"``: the section with most of its bytes, the earlier one of equals;
* ``"share"``: every section by its share of the bytes.

The line break itself belongs to the section that it ends.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str):
    """The encoding and the bytes of each token."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        size[k] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


#: Texts are encoded in parts of about so many characters, cut where the pattern can't join what is on both sides: before a
#: space or line break that follows a character that isn't white space.
_PART = 1 << 16
_CUT = re.compile(r"(?<=\S)[ \n]")


def encode(text: str, path: str) -> np.ndarray:
    """Bytes of each token of the whole text.

    A long text is encoded part by part. No token holds white space behind another character, and what the pattern looks ahead to is
    white space's successor only, so the tokens are those of the whole text at once; a run without such a place is encoded whole.
    """
    encoding, size = encoder(path)
    out, lo = [], 0
    while lo < len(text):
        cut = _CUT.search(text, lo + _PART)
        hi = cut.start() if cut else len(text)
        out.append(size[encoding.encode_ordinary(text[lo:hi])])
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def attribute(tokens: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens (given by their bytes) of each section (given by the bytes at which they end, the last at the end of the text)."""
    end = np.cumsum(tokens)
    start = end - tokens
    first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end - 1, side="right")
    if rule == "first" or not len(tokens):
        return np.bincount(first, minlength=len(ends)).astype(float)
    inner = first == last
    out = np.bincount(first[inner], minlength=len(ends)).astype(float)
    begins = np.concatenate([[0], ends[:-1]])
    for t in np.flatnonzero(~inner):
        k = np.arange(first[t], last[t] + 1)
        part = np.minimum(ends[k], end[t]) - np.maximum(begins[k], start[t])
        if rule == "most":
            out[k[np.argmax(part)]] += 1
        else:
            out[k] += part / tokens[t]
    return out


def section_tokens(docs: DataFrame, *, rule: str = "most", vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, start and end in characters, and n_tokens of each section of each document.

    Empty and null texts have one empty section; so have empty lines, which hold their line break; a line break at the end of a
    text begins no further section. Rows that repeat, or share an id, give their sections each; rows without an id are skipped;
    an empty table gives no rows; other columns are not read. Very long texts are encoded part by part with the tokens of the
    whole; of sections with equally many bytes of a token, rule "most" takes the earlier.
    """
    if rule not in ("first", "most", "share"):
        raise ValueError(f"no such rule: {rule}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                doc, section, start, end, n = [], [], [], [], []
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    lines = text.split("\n")
                    if len(lines) > 1 and not lines[-1]:
                        lines.pop()
                    chars = np.cumsum([len(x) + 1 for x in lines])
                    chars[-1] = len(text)
                    data = np.frombuffer(text.encode(), np.uint8)
                    ends = np.flatnonzero(data == 10) + 1
                    if not len(ends) or ends[-1] != len(data):
                        ends = np.concatenate([ends, [len(data)]])
                    doc.append(np.full(len(lines), key))
                    section.append(np.arange(len(lines)))
                    start.append(np.concatenate([[0], chars[:-1]]))
                    end.append(chars)
                    n.append(attribute(encode(text, vocabulary), ends, rule))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (doc, section, start, end, n)], ["doc_id", "section", "start", "end", "n_tokens"])

    return common.texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, section long, start long, end long, n_tokens double")
