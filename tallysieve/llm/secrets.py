"""Secret scans: fixed patterns, and novelty under a dictionary-primed zstandard compressor.

Three patterns give the base spans.  The method adds spans of its own.  Candidates are the
tokens, dots within them included, of which a sensitive word stands within ``REACH``
characters before or after, and the parts of a token between the sensitive words in it.
A candidate's novelty is the number of bytes that it adds to a zstandard frame that
is primed with a list of common identifiers and the text around the candidate, without
the candidate's own copies there: a key that is written twice is no less of a key.
Code, names and prose compress against that dictionary; random key material does not.
A rare word of prose adds about all its letters too, as a key does, so candidates must
also change between lower case, upper case and digits at a share of their neighbouring
characters (``CHANGES``; ``ONE_CASE`` for tokens of digits and mostly letters of one case,
as base 32 has them); keys of lower-case letters or of digits alone are not told from
prose and numbers.  Candidates that touch a base span are left to it.

Every token is found once, and every different one scored at most twice, whole and in
parts, where it first stands; the work grows with the text's length.

Defined results: null counts as the empty text and has no spans; positions are code
points of the whole text, ends exclusive; very long texts are scanned whole; repeated rows
are scanned alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.textkit import raw_texts, rewritten, text_or_empty

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

_SENSITIVE = (b"passw", b"secret", b"token", b"api", b"key", b"auth", b"credential", b"bearer", b"private", b"signature", b"cookie")
_CONTEXT = re.compile("passw|secret|token|api|key|auth|credential|bearer|private|signature|cookie", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
_CHANGE = re.compile("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]")
#: Characters between a candidate and its sensitive word, and of text around a candidate that prime its dictionary.
REACH, BEFORE, AFTER = 64, 2048, 512
#: A candidate is novel if it adds at least so many bytes and this share of its length, or enough bytes in any case.
MIN_BYTES, MIN_SHARE, SURE_BYTES = 12, 0.9, 48
#: Changes of kind for each character of a candidate, at least; the second where letters are of one case and at least so many.
CHANGES, ONE_CASE, ONE_CASE_LETTERS = 1 / 4, 1 / 10, 0.6
_SETTINGS = zstandard.ZstdCompressionParameters.from_level(9, min_match=3, window_log=17, write_checksum=0, write_content_size=0, write_dict_id=0)

_IDENTIFIERS = (
    "abstract access_token account address admin api_key application argument array async attribute author authorization await backend base64 "
    "bearer boolean buffer callback certificate channel class client client_id client_secret column component config connection constant "
    "content-type context controller cookie credential database datetime default delete description development directory document email "
    "enabled endpoint environment error event example exception export false filename format function handler header hostname identifier "
    "implements import include index instance integer interface internal iterator json length library listener localhost login message "
    "metadata method module mutable namespace null object operator option optional organization output package parameter parent password "
    "pattern permission placeholder plugin pointer port private private_key process production profile property protected provider proxy "
    "public public_key query reference register remote request require resource response result return schema secret security select sender "
    "serialize server service session session_id settings signature source static status storage string struct subscription target template "
    "test_token thread timeout timestamp token true undefined unique update upload username utf-8 validate value variable version virtual "
    "webhook www 00000000 11111111 12345678 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx http:// https:// .com .org/ get set name user by id "
)
#: The identifiers in three spellings, and what a frame begins with, so that its fixed costs aren't the candidate's.
_DICTIONARY = f"{_IDENTIFIERS.title()}{_IDENTIFIERS.upper()}{_IDENTIFIERS}".encode()
_CARRIER = _DICTIONARY[:64]

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HEXED = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))


def novelty(candidate: bytes, before: bytes, after: bytes = b"") -> int:
    """Bytes that ``candidate`` adds to a frame that is primed with identifiers and the text around it."""
    primer = zstandard.ZstdCompressionDict(_DICTIONARY + after + b"\n" + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(compression_params=_SETTINGS, dict_data=primer)
    return len(compressor.compress(_CARRIER + candidate)) - len(compressor.compress(_CARRIER))


def base_spans(text: str, raw: bytes, low: bytes) -> list[tuple[int, int, str]]:
    spans = []
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in raw.translate(_HEXED):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for i, j, _ in sorted(spans):
        if ends and i <= ends[-1]:
            ends[-1] = max(ends[-1], j)
        else:
            starts.append(i)
            ends.append(j)
    return starts, ends


def candidates(text: str) -> Iterator[tuple[tuple[int, int] | None, list[tuple[int, int]]]]:
    """For each token in sensitive context: its span if a sensitive word outside it is in reach, and its parts between sensitive words inside it."""
    words = [m.span() for m in _CONTEXT.finditer(text)]
    first = 0
    for token in _TOKEN.finditer(text):
        i, j = token.span()
        while first < len(words) and words[first][1] <= i:
            first += 1
        last = first
        while last < len(words) and words[last][0] < j:
            last += 1
        inside = words[first:last]
        outer = first > 0 and i - words[first - 1][1] <= REACH or last < len(words) and words[last][0] - j <= REACH
        if outer or inside:
            cuts = [i, *(x for span in inside for x in span), j]
            yield (i, j) if outer else None, [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b] if inside else []
        first = last


def telling(text: str) -> bool:
    """Changes between lower case, upper case and digits as often as random characters do."""
    changes = len(_CHANGE.findall(text))
    if changes >= CHANGES * len(text):
        return True
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    return changes >= max(2, ONE_CASE * len(text)) and min(upper, lower) == 0 and upper + lower >= ONE_CASE_LETTERS * len(text)


def without(own: str, before: str, after: str) -> tuple[str, str]:
    """The text around a candidate without its copies and what the outer edges leave of one."""
    before, after = before.replace(own, ""), after.replace(own, "")
    for k in range(min(len(own) - 1, len(before)), 2, -1):
        if before.startswith(own[-k:]):
            before = before[k:]
            break
    for k in range(min(len(own) - 1, len(after)), 2, -1):
        if after.endswith(own[:k]):
            after = after[:-k]
            break
    return before, after


def novel_spans(text: str, low: bytes, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int]]:
    """Incompressible candidates that touch no base span; the parts of a token only where it isn't one as a whole."""
    if not any(word in low for word in _SENSITIVE):
        return []
    starts, ends = merged(taken)
    scores: dict[str, int] = {}

    def judged(i: int, j: int) -> int:
        # A candidate adds no more bytes than it has.
        if j - i < MIN_BYTES:
            return 0
        k = bisect.bisect_right(ends, i)
        if k < len(starts) and starts[k] < j or not telling(text[i:j]):
            return 0
        own = text[i:j]
        if own not in scores:
            before, after = without(own, text[max(0, i - BEFORE) : i], text[j : j + AFTER])
            scores[own] = novelty(own.encode(), before.encode("utf-8", "replace"), after.encode("utf-8", "replace"))
        found = scores[own]
        return found if found >= SURE_BYTES or found >= MIN_BYTES and found >= MIN_SHARE * (j - i) else 0

    out = []
    for whole, parts in candidates(text):
        found = judged(*whole) if whole else 0
        if found:
            out.append((*whole, "novel", found))
        else:
            out += [(i, j, "novel", n) for i, j in parts if (n := judged(i, j))]
    return out


def spans_of(text: str, raw: bytes) -> list[tuple[int, int, str, int | None]]:
    """(start, end, kind, novelty) in order of start, then of kind; novelty for added spans only."""
    low = raw.translate(_LOWER)
    base = base_spans(text, raw, low)
    every = [(*s, None) for s in base] + novel_spans(text, low, base)
    return sorted(every, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _each(column: pa.Array) -> Iterator[tuple[str, bytes]]:
    data, offsets = raw_texts(column)
    whole = memoryview(data)
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        raw = bytes(whole[i:j])
        yield raw.decode("utf-8", "replace"), raw


_FOUND = "array<struct<kind:string,start:long,end:long,novelty:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and found: all spans of every row, by start and kind."""
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": i, "end": j, "novelty": n} for i, j, k, n in spans_of(*each)] for each in _each(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind_of)], names=["doc_id", "found"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, found {_FOUND}")


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span in its texts replaced by ``mark`` and n_chars, if there, counted anew; null stays null."""
    names = docs.columns

    def change(batch: pa.RecordBatch, whole: pa.Array) -> pa.RecordBatch:
        columns, k = list(batch.columns), names.index("text")
        texts = []
        for (text, raw), null in zip(_each(whole), columns[k].is_null().to_pylist(), strict=True):
            out, at = [], 0
            for i, j, _, _ in spans_of(text, raw):
                if i >= at:
                    out += [text[at:i], mark]
                at = max(at, j)
            texts.append(None if null else "".join(out) + text[at:] if out else text)
        columns[k] = pa.array(texts, columns[k].type)
        if "n_chars" in names:
            n = names.index("n_chars")
            changed = [o if t is None or o is None else len(t) for t, o in zip(texts, columns[n].to_pylist(), strict=True)]
            columns[n] = pa.array(changed, columns[n].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rewritten(docs, change)
