"""Secret scans over texts and what is encoded in them.

A worklist holds layers of a text: first the text itself, then whatever decodes from a stretch of a layer: percent escapes, Unicode and
character escapes, base64 (at each of its four alignments, also wrapped over lines), and compressed bytes within these. Each layer is scanned
with the same patterns, and a layer whose content was seen before in the same text is not opened again, so that cycles end. A layer
knows, in runs, which stretch of the text its characters came from, so spans are always those of the original text.

Work is bounded by the text's size: escapes nested deeper than DEEP are unwrapped to their end in one linear pass, and what streams of one
text inflate to is kept up to MOST_INFLATED bytes. A stream beyond that is scanned in windows as it inflates and forgotten, so that only
what is encoded within it stays closed; such streams are counted as ``n_unopened``.
"""

from __future__ import annotations

import base64
import hashlib
import html
import itertools
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.shared import text_or_empty

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A text without any of these has no match of the above.
ASSIGN_HINT = re.compile(r"(?:passw(?:or)?d|secret|token|api_?key)[\"' :=]", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+", re.ASCII)
ESCAPES = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:amp|quot|apos|lt|gt|equals|colon);", re.ASCII)
#: One escape of either sort at the end of what precedes it, and the characters that may end one.
ESCAPE_END = re.compile(r"(?:%[0-9A-Fa-f]{2}|" + ESCAPES.pattern + r")\Z", re.ASCII)
LONGEST_ESCAPE, ENDS = 10, frozenset("0123456789abcdefABCDEF;}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}", re.ASCII)
#: Base64 wrapped over lines: runs that end lines, and the run that the next line starts with; all lines but the first are indented alike.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n([ \t]*+)[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n\1[A-Za-z0-9+/_-]++)*+={0,2}", re.ASCII)
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: What may be read within binary data: printable stretches, also of UTF-16; no secret is shorter.
PRINTABLE = re.compile(rb"[\t\n\r -~](?:\x00?[\t\n\r -~]){11,}")
#: How gzip and zstandard streams begin; zlib's two bytes are looked for only where the data begins.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd", re.DOTALL)
#: Where compressed bytes in percent or character escapes may start, and how far they may reach.
PERCENT_STREAM = re.compile(r"(?:%1[fF]%8[bB]|(?:%78|x)%(?:01|5[eE]|9[cC]|[dD][aA])|(?:%28|\()%[bB]5(?:%2[fF]|/)%[fF][dD])", re.ASCII)
ESCAPE_STREAM = re.compile(r"(?:\\x1[fF]\\x8[bB]|(?:\\x78|x)(?:\\x(?:01|5[eE]|9[cC]|[dD][aA])|\^)|(?:\\x28|\()\\x[bB]5(?:\\x2[fF]|/)\\x[fF][dD])", re.ASCII)
#: Up to so many tokens of such bytes are read at once.
PERCENT_TOKENS, ESCAPE_TOKENS = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-~]){1,64}"), re.compile(r"""(?:\\(?:x[0-9A-Fa-f]{2}|[abfnrtv0\\'"])|[ -~]){1,64}""")
PERCENT_TOKEN, ESCAPE_TOKEN = re.compile(r"%[0-9A-Fa-f]{2}|."), re.compile(r"""\\(?:x[0-9A-Fa-f]{2}|[abfnrtv0\\'"])|.""")
BYTE = re.compile(rb"\\(?:x([0-9A-Fa-f]{2})|([abfnrtv0\\'\"]))")
LETTERS = {b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v", b"0": b"\0"}
#: A word of letters alone, in one case but for the first, is prose and not base64.
PROSE = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*", re.ASCII)
NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "equals": "=", "colon": ":"}
#: Escapes nested deeper are unwrapped at once. Most bytes that one text's streams may inflate to and still be opened further, and most bytes of
#: it that are tried as streams (again and again, where many places look like a stream's beginning).
DEEP, MOST_INFLATED, MOST_TRIED = 16, 64 << 20, 256 << 20
#: Windows of a longer stream, and how much of one is looked at again with the next.
WINDOW, AGAIN = 1 << 20, 1 << 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every match in one layer."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ASSIGN_HINT.search(text) else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _literal(s: str) -> bytes:
    """The bytes that \\x escapes and the characters between them stand for."""
    return BYTE.sub(lambda m: bytes.fromhex(m[1].decode()) if m[1] else LETTERS.get(m[2], m[2]), s.encode("latin-1", "replace"))


def _escaped(s: str) -> str:
    if s[0] == "&":
        return html.unescape(s) if s[1] == "#" else NAMED[s[1:-1]]
    code = int(s[2:].strip("{}"), 16)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else s


def _percented(s: str) -> str:
    return unquote_to_bytes(s).decode("utf-8", "replace")


class Spans:
    """Where a layer's characters came from, as runs: from each start on, either character by character, or all from one stretch."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.runs: list[tuple[int, int]] = []  # first and last place of the stretch; the last is -1 where each character has its own
        self.size = 0

    def add(self, chars: int, low: int, high: int) -> None:
        if chars:
            if high < 0 and self.runs and self.runs[-1][1] < 0 and self.runs[-1][0] + self.size - self.starts[-1] == low:
                self.size += chars  # goes on
                return
            self.starts.append(self.size)
            self.runs.append((low, high))
            self.size += chars

    def where(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the original text that characters a to b (exclusive) came from."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        low, high = self.runs[i], self.runs[j]
        return low[0] + (a - self.starts[i]) * (low[1] < 0), high[1] if high[1] >= 0 else high[0] + b - self.starts[j]

    def copy_to(self, out: Spans, a: int, b: int) -> None:
        """Adds the runs of characters a to b (exclusive) to out."""
        i = bisect_right(self.starts, a) - 1
        while a < b:
            to = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else self.size)
            low, high = self.runs[i]
            out.add(to - a, low + (a - self.starts[i]) * (high < 0), high)
            a, i = to, i + 1


def _one_run(chars: int, low: int, high: int) -> Spans:
    out = Spans()
    out.add(chars, low, high)
    return out


class Opened:
    """What one text's streams have inflated to so far, and which stayed closed."""

    def __init__(self) -> None:
        self.bytes = self.unopened = self.tried = 0

    def inflate(self, feed: Iterator[bytes], head: bytes) -> tuple[bytes | None, int, set[int]] | None:
        """What a whole compressed stream holds, how many bytes it takes, and, where it is too long to keep, the kinds of secrets in it.

        None if the bytes fed aren't a whole stream; head: their first ones, which tell its sort.
        """
        try:
            zstd = head[:1] == b"\x28"
            stream = zstandard.ZstdDecompressor().decompressobj() if zstd else zlib.decompressobj(47)
            kept, size, taken, kinds, window = [], 0, 0, set(), b""
            for data in feed:
                taken += len(data)
                self.tried += len(data)
                if self.tried > MOST_TRIED:
                    self.unopened += 1
                    return None
                for at in range(0, len(data), 1024) if zstd else (0,):  # zstandard has no bound but its input's size
                    rest = data[at : at + 1024] if zstd else data
                    while True:
                        out = stream.decompress(rest) if zstd else stream.decompress(rest, WINDOW)
                        size += len(out)
                        if self.bytes + size > MOST_INFLATED:
                            for own in (*kept, out):
                                window = window[-AGAIN:] + own
                                kinds |= {k for _, k, _ in base_spans(window.decode("latin-1"))}
                            kept = []
                        else:
                            kept.append(out)
                        rest = b"" if zstd else stream.unconsumed_tail
                        if stream.eof or not rest and (zstd or len(out) < WINDOW):
                            break
                    if stream.eof:
                        taken -= len(stream.unused_data) + (max(0, len(data) - at - 1024) if zstd else 0)
                        break
                if stream.eof:
                    break
            if not stream.eof:
                return None
        except (zlib.error, zstandard.ZstdError, MemoryError):
            return None
        if self.bytes + size > MOST_INFLATED:
            self.unopened += 1
            return None, taken, kinds
        self.bytes += size
        return b"".join(kept), taken, kinds

    def texts(self, data: bytes, whole: bool) -> Iterator[str | set[int]]:
        """The texts that bytes hold, after any layers of compression; for a stream too long to keep, the kinds of secrets in it."""
        work, seen = [data], set()
        while work:
            data = work.pop()
            digest = hashlib.sha256(data).digest()
            if digest in seen:  # a stream that inflates to itself
                continue
            seen.add(digest)
            starts = [m.start() for m in MAGIC.finditer(data)]
            if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
                starts.insert(0, 0)
            end = 0
            for at in starts:
                if at >= end and (found := self.inflate((data[i : i + 4096] for i in range(at, len(data), 4096)), data[at : at + 1])) is not None:
                    inner, taken, kinds = found
                    end = at + taken
                    if inner is None:
                        yield kinds
                    else:
                        work.append(inner)
            if end:
                continue
            text = _as_text(data) if whole or len(seen) > 1 else None
            if text is not None:
                yield text
            elif runs := PRINTABLE.findall(data):
                yield "\n".join(x.replace(b"\0", b"").decode() for x in runs)


def _as_text(data: bytes) -> str | None:
    """data as text: UTF-8 with one control character in ten at most, or a single one."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and len(CONTROL.findall(text)) <= max(1, len(text) // 10) else None


def _from_base64(s: str, opened: Opened) -> Iterator[str | set[int]]:
    """What base64 characters without line ends hold, read from each of the first four of them on."""
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    for k in range(min(4, len(body))):
        own = body[k:]
        own = own[: -1] if len(own) % 4 == 1 else own
        data = base64.b64decode(own + "=" * (-len(own) % 4))
        if k == 0 or PRINTABLE.search(data) or MAGIC.search(data) or data[:1] == b"\x78":
            yield from opened.texts(data, k == 0)


def _reduced(text: str, spans: Spans) -> tuple[str, Spans]:
    """The layer with all escapes of ASCII characters unwrapped until none is left, from left to right with a stack."""
    out: list[str] = []
    at: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        out.append(c)
        at.append(spans.where(i, i + 1))
        while out[-1] in ENDS and (m := ESCAPE_END.search("".join(out[-LONGEST_ESCAPE:]))):
            new = _percented(m[0]) if m[0][0] == "%" else _escaped(m[0])
            if len(new) != 1 or not new.isascii():
                break
            n = len(m[0])
            stretch = (at[-n][0], at[-1][1])
            del out[-n:], at[-n:]
            out.append(new)
            at.append(stretch)
    found = Spans()
    for low, high in at:
        found.add(1, low, -1 if high == low + 1 else high)
    return "".join(out), found


def decoded_layers(text: str, spans: Spans, depth: int, opened: Opened) -> Iterator[tuple[str | set[int], Spans, int]]:
    """The layers that lie within one layer, with the depth of escapes in each."""

    def replaced(pattern: re.Pattern, new) -> Iterator[tuple[str, Spans, int]]:
        """Each line that has escapes, with these replaced."""
        for group in _near(list(pattern.finditer(text))):
            a, b = _back(text, group[0].start()), _ahead(text, group[-1].end())
            out, at, pos = [], Spans(), a
            for m in group:
                out.append(text[pos : m.start()])
                spans.copy_to(at, pos, m.start())
                t = new(m[0])
                out.append(t)
                at.add(len(t), *spans.where(m.start(), m.end()))
                pos = m.end()
            out.append(text[pos:b])
            spans.copy_to(at, pos, b)
            if depth < DEEP:
                yield "".join(out), at, depth + 1
            else:
                yield *_reduced("".join(out), at), depth + 1

    if "%" in text:
        yield from replaced(PERCENT, _percented)
    if "\\" in text or "&" in text:
        yield from replaced(ESCAPES, _escaped)
    for pattern in (BASE64, WRAPPED):
        for m in pattern.finditer(text):
            s = "".join(m[0].split()) if pattern is WRAPPED else m[0]
            if not PROSE.fullmatch(s):
                stretch = spans.where(m.start(), m.end())
                for t in _from_base64(s, opened):
                    yield t, _one_run(len(t), *stretch), 0
    streams = [(PERCENT_STREAM, PERCENT_TOKENS, PERCENT_TOKEN, unquote_to_bytes)] if "%" in text else []
    streams += [(ESCAPE_STREAM, ESCAPE_TOKENS, ESCAPE_TOKEN, _literal)] if "\\x" in text else []
    for pattern, tokens, token, to_bytes in streams:
        end = 0
        while m := pattern.search(text, end):
            end = m.start() + 1
            feed = (to_bytes(x[0]) for x in _adjacent(tokens, text, m.start()))
            if (found := opened.inflate(feed, to_bytes(m[0])[:1])) is not None:
                inner, taken, kinds = found
                end = next(itertools.islice(token.finditer(text, m.start()), taken - 1, None)).end()
                for t in [kinds] if inner is None else opened.texts(inner, True):
                    yield t, _one_run(len(t), *spans.where(m.start(), end)), 0


def _adjacent(pattern: re.Pattern, text: str, at: int) -> Iterator[re.Match]:
    """Matches that follow one another without a gap."""
    while m := pattern.match(text, at):
        yield m
        at = m.end()


#: Characters to which escapes reach out on either side: all but line ends.
def _back(text: str, at: int) -> int:
    return max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1


def _ahead(text: str, at: int) -> int:
    ends = [x for x in (text.find("\n", at), text.find("\r", at)) if x >= 0]
    return min(ends, default=len(text))


def _near(matches: list[re.Match]) -> Iterator[list[re.Match]]:
    """Matches on one line come together."""
    group: list[re.Match] = []
    for m in matches:
        if group and re.search(r"[\r\n]", m.string[group[-1].end() : m.start()]):
            yield group
            group = []
        group.append(m)
    if group:
        yield group


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """The base spans of text, all spans with those found in decoded layers, (start, kind, end) and sorted, and the number of streams too long to open."""
    base = sorted(base_spans(text))
    every, seen, opened = set(base), set(), Opened()
    work: list[tuple[str, Spans, int]] = [(text, _one_run(len(text), 0, -1), 0)]
    while work:
        layer, spans, depth = work.pop()
        for t, at, deeper in decoded_layers(layer, spans, depth, opened):
            if not t:
                continue
            low, high = at.where(0, at.size)
            if isinstance(t, set):
                every.update((low, kind, high) for kind in t)
                continue
            key = (hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest(), low, high)
            if key not in seen:
                seen.add(key)
                for a, kind, b in base_spans(t):
                    low, high = at.where(a, b)
                    every.add((low, kind, high))
                work.append((t, at, deeper))
    return base, sorted(every), opened.unopened


def told(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with mark for each span, or stretch of overlapping spans; spans are sorted."""
    out, end = [], 0
    for a, _, b in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join(out) + text[end:]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex (base spans), base_sha256, spans and n_unopened of every text.

    Spans are in code points of the whole text, end exclusive. Null counts as empty; a text without spans has
    zero counts and empty lists; long ones are scanned whole, and n_unopened counts their streams that inflate to so much (see MOST_INFLATED)
    that what is encoded within them isn't opened, or that were not tried after so many others (see MOST_TRIED). Repeated rows give repeated results, null ids stay null, an empty table gives an empty
    result, and further columns are not read.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(x, T.LongType()) for x in ("n_assign", "n_access", "n_hex")] + [T.StructField(x, T.StringType()) for x in ("base_sha256", "spans")] + [T.StructField("n_unopened", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(cell.as_py()) for cell in batch.column(1)]
            counts = [pa.array([sum(x[1] == k for x in base) for base, _, _ in found], pa.int64()) for k in range(3)]
            sha = [hashlib.sha256(told(base).encode()).hexdigest() for base, _, _ in found]
            spans = [told(every) for _, every, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array([x[2] for x in found], pa.int64())], names=schema.names)

    return df.select(F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`")).mapInArrow(run, schema)


def mask_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of :func:`scan_secrets` in the texts replaced by ``mark``; null texts stay null, other columns as they are.

    Every row is read by itself: repeated rows give repeated rows, empty texts and tables stay empty, and texts are masked whole, however long.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if cell is None else masked(cell, scan(cell)[1], mark) for cell in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
