"""Token counts by section from one encoding of each whole document.

A document is its fields joined by line ends, encoded once. The byte length of every token is known
from the vocabulary, so running sums give each token's character span, and sections (the fields, or
their lines) are intervals of the same bytes: the interval join is a search in the sorted section
starts. A token that lies in two sections or more is given by an explicit rule:

- first: to the section that holds its first byte;
- most: to the section that holds most of its bytes (ties: the earlier one);
- split: to each in proportion to its bytes.

Counts over a document add up to its tokens under each rule. Defined results: null or empty fields
are empty sections with 0 tokens; repeated rows give repeated rows; a null doc_id is kept; extra
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_LOADED: dict[str, tuple] = {}


def load(path: str, pattern: str):
    """The encoder and the byte length of each of its tokens, once for each worker process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        length[list(ranks.values())] = list(map(len, ranks))
        _LOADED[path] = (tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length)
    return _LOADED[path]


def sections_of(values: list[str], by_line: bool) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The document's bytes, the start of each section and its field. A section's end is the next one's start."""
    data = b"\n".join(v.encode("utf-8", "replace") for v in values)
    sizes = np.array([len(v.encode("utf-8", "replace")) + 1 for v in values], np.int64)
    fields = np.cumsum(sizes) - sizes
    if not by_line:
        return data, fields, np.arange(len(values))
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    starts = np.concatenate([[0], ends])
    return data, starts, np.searchsorted(fields, starts, "right") - 1


def allocate(starts: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; a token covers bytes first..last (end exclusive)."""
    n = len(starts)
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, np.maximum(last - 1, first), "right") - 1
    if rule == "first" or not len(first):
        return np.bincount(a, minlength=n).astype(float)
    out = np.bincount(a[a == b], minlength=n).astype(float)
    bounds = np.append(starts, np.iinfo(np.int64).max)
    for i in np.flatnonzero(a != b):  # the few tokens that cross a boundary
        k = np.arange(a[i], b[i] + 1)
        part = np.minimum(bounds[k + 1], last[i]) - np.maximum(bounds[k], first[i])
        if rule == "split":
            out[k] += part / part.sum()
        else:
            out[k[np.argmax(part)]] += 1
    return out


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, fields: tuple[str, ...] = ("text",), by_line: bool = True, rule: str = "first") -> DataFrame:
    """doc_id, field, section (from 0 in its document), start_byte, n_bytes, n_tokens for each section."""
    if rule not in ("first", "most", "split"):
        raise ValueError(f"unknown rule {rule}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, length = load(vocabulary, pattern)
        for pdf in batches:
            own, parts = [], []
            for i, values in enumerate(zip(*[pdf[f"f{k}"] for k in range(len(fields))], strict=True)):
                data, starts, field = sections_of([v or "" for v in values], by_line)
                ids = np.asarray(encoding.encode_ordinary(data.decode("utf-8")), np.int64)
                last = np.cumsum(length[ids])
                n = allocate(starts, last - length[ids], last, rule)
                own.append(np.full(len(starts), i))
                parts.append(np.stack([field, np.arange(len(starts)), starts, np.diff(np.append(starts, len(data))), n]))
            if parts:
                x, at = np.concatenate(parts, axis=1), np.concatenate(own)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].take(at).to_numpy(), "field": np.array(fields)[x[0].astype(int)], "section": x[1].astype(np.int64), "start_byte": x[2].astype(np.int64), "n_bytes": x[3].astype(np.int64), "n_tokens": x[4]})

    columns = docs.select("doc_id", *[docs[f].cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    return columns.mapInPandas(run, "doc_id long, field string, section long, start_byte long, n_bytes long, n_tokens double")
