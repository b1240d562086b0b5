"""Secret scan: fixed base patterns, and strings in a sensitive context that zstandard cannot predict.

A candidate is a run of 16 or more token characters with letters and digits that stands where keys
stand: after an assignment, a header's or a URL's separator, in quotes, after a word for secrets, or with
the prefix of a known kind of key. Its novelty is the number of bytes that it adds when the text around it
is compressed with a dictionary: bytes(context + candidate) - bytes(context), over the candidate's
length. The dictionary holds common identifiers of code (a fixed list) and the WORDS words that the most
texts of the whole corpus have (rows that repeat count again; words have no digits, so no secret gets in). Identifiers, paths, dates and repeated strings cost little; random keys cost most of
their bytes.

Defined results: null or empty text has no spans; repeated rows give repeated rows; a null doc_id is
kept; extra columns are ignored; an empty table gives no rows. Spans are in code points, end exclusive, of
the whole match; a novel span overlaps no base span.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]+", re.A)
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}", re.A)
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.A)
# What stands before a key, and how keys of known kinds begin.
BEFORE = re.compile(
    r"""(?:["'`]|[A-Za-z0-9_.\])-]["']?\s{0,3}(?:=>|:=|[:=])\s{0,3}["']?|://[^\s/@:]{1,40}:"""
    r"""|\b(?:password|passwd|pwd|secret|token|api[_-]?key|credentials?|private[_-]?key|auth\w*|bearer|basic|key)\b[^\n]{0,40})$""",
    re.I | re.A,
)
PREFIX = re.compile(r"(?:AKIA|ASIA|AIza|eyJ|gh[pousr]_|github_pat_|glpat-|sk[_-]|pk_|rk_|xox[abprs]-|npm_|SG\.|ya29\.)", re.A)
WORD = re.compile(r"[A-Za-z_]{4,}", re.A)
# Words of the identifier dictionary.
IDENTIFIERS = """access account address admin alias application array attribute authentication authorization base64 bearer
boolean bucket buffer callback client cluster column config configuration connection const container content context
credential credentials database default document endpoint environment example exception export false filename format
function global handler header host import index instance integer interface internal json key label length local
localhost message method module name namespace null object option output package parameter password path placeholder
private production property protected public query register request resource response result return schema secret
select server service session setting static status string system table temp template test timestamp token true
type undefined update url user username value variable version void your_api_key your_password_here changeme""".split()
REACH, AROUND, LEAST_NOVELTY, WORDS = 64, 200, 0.9, 2000
#: Words counted in a task before their counts are sent on.
HELD = 100_000


def dictionary_of(docs: DataFrame) -> str:
    """The words of the dictionary, the most common at the end, where a reference to them is shortest."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                counts.update(set(WORD.findall(t)))
            if len(counts) > HELD:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts = Counter()
        yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})

    counted = docs.filter("text is not null").select("text").mapInPandas(words, "word string, n long").filter("length(word) <= 40")
    common = counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    found = [r["word"] for r in common.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    return "\n".join([*reversed(found), *IDENTIFIERS])


def _compressor(dictionary: str | None = None) -> zstandard.ZstdCompressor:
    data = (dictionary or "\n".join(IDENTIFIERS)).encode()
    primed = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=9)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


#: A match of HEX is a whole run of its characters, so the runs of 24 or more are found directly.
LONG_HEX = re.compile(r"[0-9a-f]{24,}", re.A)


def novelty(zc: zstandard.ZstdCompressor, text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of text[start:end] against what stands around it, over its length."""
    around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode("utf-8", "replace")
    own = text[start:end].encode("utf-8", "replace")
    return (len(zc.compress(around + own)) - len(zc.compress(around))) / len(own)


def novel_spans(zc: zstandard.ZstdCompressor, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if not MIXED.match(m[0]) or any(x < b and a < y for x, _, y in taken):
            continue
        if not (PREFIX.match(m[0]) or "=" in m[0][:-2] or BEFORE.search(text, max(0, a - REACH), a)):
            continue
        if novelty(zc, text, a, b) >= LEAST_NOVELTY:
            out.append((a, 3, b))
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256 and spans for each row."""
    dictionary = dictionary_of(docs)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zc = _compressor(dictionary)
        name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                base = base_spans(text)
                more = novel_spans(zc, text, base)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((doc_id, *n, len(more), hashlib.sha256(name(base).encode()).hexdigest(), name(sorted(base + more))))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])
            out["doc_id"] = pdf["doc_id"].to_numpy() if len(pdf) else out["doc_id"]
            yield out

    return docs.select("doc_id", "text").mapInPandas(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with each span (as scan_secrets names them) replaced by a fixed mark."""
    cuts = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b in cuts:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every span, base or novel, replaced by a mark; n_chars follows the text where there is one."""
    dictionary = dictionary_of(docs)

    @F.pandas_udf(StringType())
    def clean(text: pd.Series) -> pd.Series:
        zc = _compressor(dictionary)
        out = []
        for t in text:
            spans = base_spans(t) if t else []
            spans += novel_spans(zc, t, spans) if t else []
            out.append(redact(t, ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))) if spans else t)
        return pd.Series(out, dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
