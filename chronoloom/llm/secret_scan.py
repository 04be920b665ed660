"""Secret scans with a worklist of decoded layers: URL, Unicode and base64 encodings and compressed bytes are unwrapped until nothing new turns up.

The text itself is the first layer. A line with %XX or \\uXXXX escapes gives a layer of that line decoded, each character knowing where it came from; a
run of base64 (over line ends too, or a part of it between slashes, hyphens or underscores) that decodes to text, or to gzip or zlib bytes, compressed
however often, that hold text, gives a layer whose characters all stand for the run. Text is UTF-8, UTF-16, or bytes that are mostly printed characters;
compressed bytes that break off give what they hold. Each layer is scanned and searched for further ones, and a layer that the same place of the document has already given isn't taken up again, so chains of encodings end.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}")
ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: A base64 run that goes on over line ends: the lines after its first hold nothing else, but for what may follow the last of them if the first is long.
NEXT = r"[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+={0,2}"
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}(?:{NEXT}(?=[\x20\t]|\r?\n|\Z))+|[A-Za-z0-9+/_-]{{4,}}(?:{NEXT}(?=[\x20\t]*(?:\r?\n|\Z)))+)")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
APART = re.compile(r"[/_-]")

Span = tuple[int, int, int]


def scan(text: str) -> list[Span]:
    """(start, kind, end) of the base kinds, leftmost and without overlap for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


#: Bytes that text has; and the share of them from which bytes that aren't quite text are read all the same.
PRINTED = np.isin(np.arange(256), [9, 10, 11, 12, 13, *range(32, 127)])
MOSTLY = 0.85


def _plain(raw: bytes) -> str | None:
    """Bytes as text, if they are UTF-8 without control characters."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if len(text) >= 4 and not re.search(r"[\x00-\x08\x0E-\x1F\x7F]", text) else None


def _roughly(raw: bytes) -> str | None:
    """Bytes as text that are UTF-16, or mostly printed characters: then each byte is one."""
    if len(raw) < 8:
        return None
    b = np.frombuffer(raw, np.uint8)
    for order, zero, other in (("utf-16-le", b[1::2], b[0::2]), ("utf-16-be", b[0::2], b[1::2])):
        if (zero == 0).mean() >= MOSTLY and (other != 0).mean() >= MOSTLY:
            return raw[: len(raw) // 2 * 2].decode(order, "replace").removeprefix("\ufeff")
    return raw.decode("latin-1") if PRINTED[b].mean() >= MOSTLY else None


def _decompressed(raw: bytes) -> tuple[bytes | None, bool]:
    """What gzip or zlib bytes hold, all members of them, the last as far as it goes (None if they hold nothing); and whether they end with a member's end."""
    out, at, ended = [], raw, False
    for bits, magic in ((31, b"\x1f\x8b"), (15, b"\x78")):
        while at.startswith(magic):
            d = zlib.decompressobj(bits)
            for k in range(0, len(at), 256):
                try:
                    out.append(d.decompress(at[k : k + 256]))
                except zlib.error:
                    break
                if d.eof:
                    break
            if not d.eof:
                ended = False
                break
            at = d.unused_data + at[k + 256 :]
            ended = not at
        if any(out):
            return b"".join(out), ended
    return None, False


def _unpacked(raw: bytes, exact: bool = False) -> list[str]:
    """The texts that bytes hold: themselves, or what is left of them after as many decompressions as there are. `exact`: only if they are quite text."""
    out, seen = [], set()
    while raw not in seen:
        seen.add(raw)
        below, _ = _decompressed(raw)
        if (text := _plain(raw)) is not None or (below is None and not exact and (text := _roughly(raw)) is not None):
            out.append(text)
        if below is None:
            break
        raw = below
    return out


def _unescaped(text: str) -> tuple[str, list[int], list[int]] | None:
    """A line with its escapes decoded, and each character's start and end in the line; None if there are none that decode."""
    out, starts, ends, at, changed = [], [], [], 0, False

    def add(chars: str, a: int, step: int, widths: list[int] | None = None) -> None:
        for k, c in enumerate(chars):
            n = widths[k] if widths else step
            out.append(c)
            starts.append(a)
            ends.append(a + n)
            a += n

    for m in ESCAPES.finditer(text):
        add(text[at : m.start()], at, 1)
        at = m.end()
        if m[0][0] == "%":
            raw = bytes.fromhex(m[0].replace("%", ""))
            try:
                chars = raw.decode("utf-8")
                widths = [3 * len(c.encode()) for c in chars]
            except UnicodeDecodeError:
                chars, widths = raw.decode("latin-1"), [3] * len(raw)
        else:
            units = b"".join(bytes.fromhex(m[0][k + 2 : k + 6]) for k in range(0, len(m[0]), 6))
            chars = units.decode("utf-16-be", "replace")
            widths = [12 if ord(c) > 0xFFFF else 6 for c in chars]
            if sum(widths) != len(m[0]):
                chars, widths = m[0], [1] * len(m[0])
        add(chars, m.start(), 1, widths)
        changed |= chars != m[0]
    add(text[at:], at, 1)
    return ("".join(out), starts, ends) if changed else None


def _bytes(run: str) -> bytes:
    """A run of base64 as bytes, without what is over at its end."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return b""


def _base64(run: str, exact: bool = True) -> list[str]:
    return [] if exact and len(run.rstrip("=")) % 4 == 1 else _unpacked(_bytes(run), exact)


def _in_run(run: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of what a run of base64 characters holds: the whole run if it decodes; else, as slashes, hyphens and underscores may also stand
    around it, from each of them on what looks like text or compressed bytes, up to one of them where it decodes, and otherwise to the run's end."""
    if found := _base64(run):
        yield from ((0, len(run), text) for text in found)
        return
    cuts = [m.start() for m in APART.finditer(run)]
    done = 0
    for start in [0, *(c + 1 for c in cuts)]:
        if start < done or len(run) - start < 16:
            continue
        head = _bytes(run[start : start + 24])
        if not (head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" or _roughly(head[:16]) is not None or _plain(head[:15]) is not None):
            continue
        raw = _bytes(run[start:])
        clean = np.frombuffer(raw, np.uint8)
        clean = int(np.argmin(np.append(PRINTED[clean] | (clean >= 128), False)))
        most = bisect.bisect_right(cuts, start + clean * 4 // 3 + 2) - 1
        stops = [len(run), *([cuts[most]] if most >= 0 and cuts[most] - start >= 16 else []), *([n] if (n := next((c for c in cuts if c - start >= 16), None)) else [])]
        for stop in dict.fromkeys(stops):
            if found := _base64(run[start:stop]):
                break
        else:
            stop, found = len(run), _base64(run[start:], exact=False)
        if found:
            yield from ((start, stop, text) for text in found)
            done = stop


def _wrapped(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """Layers of base64 that goes on over line ends. Text stands for the lines that hold its bytes, decompressed text for all of them.

    A run ends with the first line shorter than the lines between, or before this line, or with all lines, whichever first gives text or compressed bytes
    that end there; failing that, with the first of these that gives anything. Its first line, which other text may precede, is left out if nothing decodes with it."""
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in LINE.finditer(m[0])]
        for first in (0, 1):
            rest = lines[first:]
            if len(rest) < 2:
                break
            wide = rest[1][1] - rest[1][0]
            full = 1 + next((k for k, (a, z) in enumerate(rest[1:]) if z - a != wide), len(rest) - 1)
            short = full + (full < len(rest) and rest[full][1] - rest[full][0] < wide)
            best: tuple[list, str, list[str]] | None = None
            for n in dict.fromkeys((short, full, len(rest))):
                part = rest[:n]
                body = "".join(text[a:z] for a, z in part)
                if n > 1 and len(body) >= 16 and (found := _base64(body)):
                    inner, ended = _decompressed(_bytes(body))
                    best = best or (part, body, found)
                    if inner is None or ended:  # else bytes are missing, or others follow
                        best = (part, body, found)
                        break
            if best is None:
                continue
            part, body, found = best
            for decoded in found:
                raw = decoded.encode()
                if len(raw) == len(body.rstrip("=")) * 3 // 4:  # nothing was compressed
                    ends = np.cumsum([z - a for a, z in part])
                    begins = np.cumsum([0, *(len(c.encode()) for c in decoded)])
                    low = np.searchsorted(ends, begins[:-1] * 8 // 6, "right").tolist()
                    high = np.searchsorted(ends, (begins[1:] * 8 - 1) // 6, "right").tolist()
                    yield decoded, [part[k][0] for k in low], [part[k][1] for k in high]
                else:
                    yield decoded, [part[0][0]] * len(decoded), [part[-1][1]] * len(decoded)
            break


def _layers(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """Layers right below a text, with start and end there of each of their characters."""
    if ESCAPED.search(text):
        at = 0
        for line in text.split("\n"):
            if found := _unescaped(line):
                decoded, starts, ends = found
                yield decoded, [at + s for s in starts], [at + e for e in ends]
            at += len(line) + 1
    for m in BASE64.finditer(text):
        for a, z, decoded in _in_run(m[0]):
            yield decoded, [m.start() + a] * len(decoded), [m.start() + z] * len(decoded)
    yield from _wrapped(text)


def scan_layers(text: str) -> set[Span]:
    """Spans in a text of secrets in it and in all layers below."""
    found = set(scan(text))
    work = [(text, None, None)]
    seen = {(0, len(text), text)}
    while work:
        layer, starts, ends = work.pop()
        for below, s, e in _layers(layer):
            if starts is not None:
                s, e = [starts[x] for x in s], [ends[x - 1] for x in e]
            if not below or (mark := (s[0], e[-1], below)) in seen:
                continue
            seen.add(mark)
            found.update((s[a], kind, e[b - 1]) for a, kind, b in scan(below))
            work.append((below, s, e))
    return found


def written_as(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, secrets array<struct<kind, start, end, decoded>>) for each row of `docs`.

    The counts and base_sha256 are those of the text itself; spans and secrets also have what the layers below add (decoded: not in the text itself).
    A null text is an empty one and has none; an empty table gives none. A text is worked on whole, in memory, however long. Rows are worked on alone; repeated rows and null keys come out as they are; other columns are dropped.
    """
    schema = f"{key} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, secrets array<struct<kind:string,start:int,end:int,decoded:boolean>>"
    secret = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("decoded", pa.bool_())])
    arrow = pa.schema([(key, pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("secrets", pa.list_(secret))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for k, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    value = value.as_py()
                    base = scan(value)
                    every = sorted(scan_layers(value))
                    own = set(base)
                    n = [sum(s[1] == kind for s in base) for kind in range(3)]
                    out.append({key: k, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(written_as(base).encode()).hexdigest(), "spans": written_as(every), "secrets": [{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "decoded": s not in own} for s in every]})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return docs.select(docs[key].cast("long").alias(key), F.coalesce(docs[text], F.lit("")).alias("text")).mapInArrow(freeing(run), schema)
