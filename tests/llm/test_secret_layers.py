"""Layers that hide secrets: each way alone, and drawn nestings of them against what was hidden."""

import base64
import gzip
import random
import zlib
from urllib.parse import quote

import pytest

from chronoloom.llm import secret_scan

SECRET = "token=abcdefgh1234"


def b64(raw):
    return base64.b64encode(raw).decode()


def url64(raw):
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def added(text):
    own = set(secret_scan.scan(text))
    return [text[a:z] for a, k, z in secret_scan.scan_layers(text) if (a, k, z) not in own]


@pytest.mark.parametrize(
    "text",
    [
        "see https://h.example/a/" + b64(SECRET.encode()), "https://h.example/files/v2/" + url64(("x " * 20 + SECRET).encode()) + "/raw", "key-" + b64(SECRET.encode()), "my_key_" + url64(SECRET.encode()),
        b64(SECRET.encode("utf-16-le")), b64(SECRET.encode("utf-16")), b64(SECRET.encode("utf-16-be")),
        b64(b"some words before " + SECRET.encode() + b"\x00 and after"), b64(b"\x1b[1m words here " + SECRET.encode() + b" end"), b64(b"words caf\xe9 here " + SECRET.encode() + b" end"),
        b64(gzip.compress(("many words before it all " + SECRET + " and after it").encode())[:-6]), b64(zlib.compress((SECRET + " and more").encode())[:-3]), b64(gzip.compress(gzip.compress(SECRET.encode()))),
        b64(gzip.compress(b"first ") + gzip.compress(SECRET.encode())), "path/to/" + b64(gzip.compress(SECRET.encode())),
    ],
)
def test_each_layer_is_opened(text):
    assert len(added(text)) == 1 and SECRET not in text


def test_spans_leave_out_what_stands_around():
    inner = b64(SECRET.encode())
    assert added(f"https://h.example/a/{inner}") == [inner]
    assert added(f"go to https://h.example/a/{inner} now") == [inner]


def test_clean_runs_give_nothing():
    r = random.Random(1)
    text = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789-_/+") for _ in range(r.randrange(16, 400))) for _ in range(300))
    assert added(text) == []


def wrap(r, text):
    """One layer around a text, and its name."""
    kind = r.choice(["percent", "unicode", "base64", "url64", "gzip", "zlib", "utf16", "path", "wrapped"])
    raw = text.encode()
    return {
        "percent": lambda: quote(text, safe=""), "unicode": lambda: "".join(f"\\u{ord(c):04x}" for c in text), "base64": lambda: b64(raw), "url64": lambda: url64(raw), "gzip": lambda: b64(gzip.compress(raw)),
        "zlib": lambda: b64(zlib.compress(raw)), "utf16": lambda: b64(text.encode("utf-16-le")), "path": lambda: "https://h.example/a/" + b64(raw), "wrapped": lambda: "\n".join(b64(gzip.compress(raw))[k : k + 76] for k in range(0, 10**6, 76) if k < len(b64(gzip.compress(raw)))),
    }[kind](), kind


@pytest.mark.parametrize("seed", range(150))
def test_drawn_nestings(seed):
    """Up to four layers, in any order, with words around: the secret is found within what hides it, and nowhere else."""
    r = random.Random(seed)
    said = lambda n: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 7))) for _ in range(n))
    hidden = f"{said(3)} {SECRET} {said(2)}"
    kinds = []
    for _ in range(r.randrange(1, 5)):
        hidden, kind = wrap(r, hidden)
        kinds.append(kind)
        if r.random() < 0.3 and "\n" not in hidden:
            hidden = f"{said(2)} {hidden} {said(1)}"
    before = said(5) + "\n"
    text = before + hidden + "\n" + said(4)
    spans = [x for x in secret_scan.scan_layers(text) if x not in set(secret_scan.scan(text))]
    assert spans, kinds
    assert all(len(before) <= a < z <= len(before) + len(hidden) for a, _, z in spans), kinds


def test_cycles_and_depth_end():
    text = SECRET
    for _ in range(20):
        text = b64(text.encode())
    assert len(added(text)) == 1
    assert added("%25" * 400) == []


def test_tables(spark):
    docs = spark.createDataFrame([(1, b64(SECRET.encode()), "x"), (1, b64(SECRET.encode()), "x"), (2, None, "y"), (None, SECRET, "z"), (3, "word " * 200_000 + b64(SECRET.encode()), "w")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.n_assign, len(r.secrets)) for r in secret_scan.scan_documents(docs).collect())
    assert got == [(0, 1, 1), (1, 0, 1), (1, 0, 1), (2, 0, 0), (3, 0, 1)]
    assert secret_scan.scan_documents(docs.limit(0)).count() == 0
