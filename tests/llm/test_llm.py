"""Text operators against brute force on a small table that holds the awkward cases."""

import hashlib
import io
import random
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from chronoloom.llm import bpe, chat, common, decontaminate, jaccard, line_dedup, media, passages, secret_scan, sharding, shingles, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COLS = "doc_id long, text string, lang string, n_words string"


def words(r, n, size=40):
    return [r.choice("abcdefgh") + str(r.randrange(size)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    out = {}
    for k in range(60):
        out[k] = "\n".join(" ".join(words(r, r.randrange(3, 40), 400)) for _ in range(r.randrange(1, 8)))
    line = "this very line of well over forty characters stands in many texts"
    for k in range(0, 30, 3):
        out[k] += "\n  " + (line.upper() if k % 2 else line) + "\t"
    base = words(r, 200, 4000)
    for k in range(60, 75):  # near copies
        w = list(base)
        for _ in range(r.randrange(1, 12)):
            w[r.randrange(len(w))] = "x" + str(r.randrange(99))
        out[k] = " ".join(w)
    for k in range(75, 80):  # exact copies
        out[k] = " ".join(base)
    out |= {80: "", 81: None, 82: " \n\t\n", 83: "é" * 50 + " ß 日本語 " + "\U0001f600" * 3, 84: "one two three", 85: "ONE  two\nthree", 86: "a " * 3000 + "b" * 5000, 87: "\x1c\x00 \x7f\r\n\r\n"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "x") for k, t in texts.items()], COLS).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLS)


def raw(t):
    return (t or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


# 1

def test_media(docs, empty, texts):
    for r in media.media_column(docs).collect():
        payload = raw(texts[r.doc_id])
        payload += b" " * (-len(payload) % 192 or (0 if payload else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw(texts[r.doc_id])), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), sha(bytes(r.media)))
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
    assert media.media_column(empty).count() == 0


def test_fingerprint_finds_a_tone():
    t = np.arange(192 * 40)
    tone = lambda f: (128 + 100 * np.sin(2 * np.pi * f / 192 * t) * (1 + np.sin(t / 700))).astype(np.uint8).tobytes()
    codes = media.fingerprint(tone(40))
    assert len(codes) and (np.diff(codes) >= 0).all()
    assert Counter((codes >> 16 & 255).tolist()).most_common(1)[0][0] in (39, 40, 41)
    assert len(media.fingerprint(b" " * 192 * 10)) == 0 == len(media.fingerprint(b""))
    blocks, media.BLOCK = media.BLOCK, 7
    assert (media.fingerprint(tone(40)) == codes).all()
    media.BLOCK = blocks


# 2

@pytest.fixture(scope="module")
def library():
    return bpe.coder(RANKS, public_tokenizers.PATTERN).library


def test_bpe(docs, texts, library):
    for kw in ({}, {"split_chars": 300, "chunk": 90, "overlap": 20}):
        rows = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, columns=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"), **kw).collect()
        assert sorted(r.doc_id for r in rows) == sorted(texts)
        for r in rows:
            ids = library.encode_ordinary(texts[r.doc_id] or "")
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == sha(" ".join(map(str, ids)).encode())
            assert bytes(r.decoded) == raw(texts[r.doc_id]) and r.decoded_sha256 == sha(raw(texts[r.doc_id]))


def test_bpe_repeated_rows_and_nothing(docs, empty, spark):
    long = docs.where("doc_id = 86")
    assert bpe.encode_documents(long.union(long), RANKS, public_tokenizers.PATTERN, split_chars=10).count() == 2
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {r.doc_id: raw(r.text) for r in docs.collect()}


def test_stitching_is_exact():
    r, split = random.Random(3), regex.compile(public_tokenizers.PATTERN)
    for _ in range(400):
        text = "".join(r.choice(["a", "B", "é", "1", " ", "  ", "\n", "'", "'s", "'ll", "'re", "日", "!", "\t", "_" * 9, "z" * 12]) for _ in range(r.randrange(80)))
        bounds = bpe.stitched(split, text, r.randrange(5, 20), r.randrange(0, 12))
        assert bpe.pieces_of(text, bounds) == split.findall(text)


# 3

def test_shards(docs, empty, texts, spark):
    rows = sharding.assign(docs, 7).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law) == (len(raw(texts[r.doc_id])) + 16, zlib.crc32(raw(texts[r.doc_id])), "key")
        assert r.grown_shard in (r.shard, 7)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = {r.doc_id: r.shard for r in sharding.assign(docs.repartition(2), 8).collect()}
    assert grown == {r.doc_id: r.grown_shard for r in rows}
    assert sharding.assign(empty, 7).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert len({r.shard for r in sharding.assign(odd, 7).collect() if r.doc_id is None}) == 1


def test_shard_weights(spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r.shard: r["count"] for r in sharding.assign(many, 3, weights=[1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(many, 3, weights=[1.0])


# 4

def brute_contamination(text, items, n=10):
    import re

    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w = low(text)
    hit, found = set(), set()
    for item, t in items:
        v = low(t)
        size = min(n, len(v))
        for k in range(len(v) - size + 1 if size else 0):
            for a in range(len(w) - size + 1):
                if w[a : a + size] == v[k : k + size]:
                    hit |= set(range(a, a + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 10])
def test_decontamination(spark, docs, empty, texts, block):
    items = [(1, " ".join(texts[0].split()[:25]) + " and more"), (10, "One; TWO three!"), (2, texts[63]), (3, None), (4, "--"), (5, "one two THREE"), (6, "é" * 50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs, bench, remove="spans", keep=("lang",), block_bytes=block).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, h, found = brute_contamination(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (n, h, len(found), found, h > 0)
        assert r.items_sha256 == sha(",".join(found).encode())
        if h:
            assert len(decontaminate.split_words(r.clean_text.encode())) == n - h
        else:
            assert r.clean_text == (texts[r.doc_id] or "")
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


# 5

def test_template_language():
    assert chat.render("{{ 'a' + 'b' | upper }}{% if 1 == 2 %}x{% elif not 0 == 1 %}y{% else %}z{% endif %}", []) == ("ABy", [])
    assert chat.fold(chat.parse("a{{ 'b' }}{% if 1 == 1 %}c{% endif %}d")) == ("all", [("text", "abcd")])
    assert chat.render("{% for m in messages %}{% if loop.first %}<{% endif %}{% generation %}{{ m.text }}{% endgeneration %}{% if loop.last %}>{% else %},{% endif %}{% endfor %}", [{"text": "x"}, {"text": "yy"}]) == ("<x,yy>", [(1, 2), (3, 5)])
    for bad in ("{% for %}", "{{ a b }}", "{% endif %}", "{{ x | nothing }}", "{% if 1 == 1 %}", "{{ x() }}", "{% import os %}", "{{ ''.__class__ }}"):
        with pytest.raises(chat.TemplateError):
            list(chat.compile_template(bad)([]))
    with pytest.raises(chat.TemplateError):
        list(chat.compile_template("{{ messages.__class__ }}")([]))


def test_templates_that_a_stream_can_not_serve(spark):
    twice = "{% for m in messages %}{{ m.text }}{% endfor %}|{% for m in messages %}{{ m.text }}{% endfor %}"
    assert chat.render(twice, [{"role": "a", "text": "x"}])[0] == "x|x"
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(chat.TemplateError, match="once"):
        chat.format_conversations(rows, twice)
    with pytest.raises(chat.TemplateError, match="deep"):
        chat.compile_template("{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}")


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "&lt;s> & <s>", "", None, "[", "<", "/s>", "[INST", "a\nb&amp;", "x" * 50, "]"]
    rows = [(-7, 0, "user", said[0]), (-7, 1, "assistant", said[0])] + [(c, t, r, said[(c * 5 + t * 3) % len(said)]) for c in range(30) for t, r in enumerate(["system", "user", "assistant", None, "us\ner<s>", "assistant"])]
    rows += [(None, None, "user", "q"), (None, 1, "assistant", "w"), (None, 1, "assistant", "w")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    for segment in (1 << 20, 20):
        made = chat.format_conversations(df, segment=segment)
        got = {r.conv_id: r for r in chat.summaries(made).collect()}
        assert set(got) == {r[0] for r in rows}
        for c, r in got.items():
            mine = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))
            turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
            loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), sha(turns.encode()), len(loss), sha(loss.encode()))
    assert chat.summaries(chat.format_conversations(df.limit(0))).count() == 0
    one = chat.format_conversations(df.where("conv_id = -7")).first()
    assert one.formatted.count("</s>") == 1 and one.formatted.count("[INST]") == 1


# 6

def brute_sets(texts, n=5):
    out = {}
    for k, t in texts.items():
        w = raw(t).lower().split()
        out[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def brute_components(texts):
    sets = brute_sets(texts)
    comp = {k: k for k in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return sets, comp


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(docs, empty, texts, small, monkeypatch):
    if small:  # hot shingles in blocks, groups of sets in several cuts, few partners in the first rounds
        monkeypatch.setattr(jaccard, "GROUP", 4)
        monkeypatch.setattr(jaccard, "FRAGMENT", 500)
        monkeypatch.setattr(jaccard, "ROUNDS", (1, None))
    sets, comp = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got == {k: (len(sets[k]), comp[k]) for k in sets}
    assert jaccard.similar_documents(empty).count() == 0


def test_jaccard_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.similar_documents(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]


def test_jaccard_of_very_long_near_copies(spark):
    """More shingles in a cell of the histogram than a byte counts."""
    base = [f"w{k}" for k in range(90_000)]
    other, third = list(base), list(base)
    other[500] = other[70_000] = "x"
    third[::20] = ["y"] * 4500  # a quarter of the shingles: not alike
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((base, other, third))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_word_hashes_do_not_depend_on_blocks(texts, monkeypatch):
    raws = [raw(t) for t in texts.values()]
    want = shingles.word_hashes(raws)
    assert [len(w) for w in want] == [len(r.lower().split()) for r in raws]
    monkeypatch.setattr(shingles, "BLOCK", 64)
    assert all((a == b).all() for a, b in zip(want, shingles.word_hashes(raws), strict=True))


@pytest.mark.parametrize("few", [1 << 20, -1])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(common, "FEW", few)
    r = random.Random(5)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000, k) for k in range(1001, 1100)]
    comp = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x.node: x.component for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == comp
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7

def brute_lines(texts, min_chars=40, min_docs=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for k, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(k)
    out = {}
    for k, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders[key(x)]) >= min_docs and k != max(holders[key(x)]))]
        out[k] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def lines_of(docs, index):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs, index).collect()}


def test_line_dedup_is_reversible(docs, empty, texts):
    want = brute_lines(texts)
    index = line_dedup.LineIndex.of(docs, shards=3)
    assert lines_of(docs, index) == want
    part = docs.where("doc_id < 20")
    grown = line_dedup.LineIndex.of(part, shards=3).insert(docs.where("doc_id >= 20"))
    assert lines_of(docs, grown) == want
    assert lines_of(docs, grown.insert(part)) == want  # there already
    less = grown.delete(docs.where("doc_id >= 20"))
    few = {k: t for k, t in texts.items() if k < 20}
    assert lines_of(part, less) == brute_lines(few)
    back = less.insert(docs.where("doc_id >= 20"))
    assert lines_of(docs, back) == want
    assert lines_of(empty, line_dedup.LineIndex.of(empty)) == {}


def test_line_dedup_in_blocks_and_with_odd_rows(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)  # a block for each shard
    assert lines_of(docs, line_dedup.LineIndex.of(docs, shards=7)) == brute_lines(texts)
    line = "x" * 40
    df = spark.createDataFrame([(k, line, None) for k in (1, 2, 3, 4, 5, 5, None)], "doc_id long, text string, kept string")
    got = sorted(((r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(df, line_dedup.LineIndex.of(df)).collect()))
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (5, 0)]


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000)
    made = line_dedup.CuckooFilter.of(keys)
    assert made.might_hold(keys).all()
    other = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 20000)
    assert made.might_hold(other).mean() < 0.01
    for k in keys[:1500]:
        assert made.remove(int(k))
    assert made.might_hold(keys[1500:]).all() and made.might_hold(keys[:1500]).mean() < 0.02


# 8

def test_secrets(spark):
    import base64
    import gzip
    import re

    inner = 'password = "hunter2secret"'
    b64 = base64.b64encode(inner.encode()).decode()
    cases = {
        1: f"x {inner} y", 2: "token%3D%22abcdef123%22 é", 3: f"日 {b64} z", 4: "see " + base64.b64encode(b64.encode()).decode(),
        5: "a " + base64.b64encode(gzip.compress(inner.encode())).decode(), 6: "AKIA" + "A1" * 8 + " " + "0f" * 12 + " api_key:'12345'", 7: None, 8: "",
        9: "secret: \\u0061\\u0062cdefgh", 10: "ſecret=abcdefgh toKen=abcdefg", 11: f"{b64} {b64}", 12: "password=%70%61ss" + "%41" * 20,
    }
    rows = {r.doc_id: r for r in secret_scan.scan_documents(spark.createDataFrame([(k, t, "q") for k, t in cases.items()], "doc_id long, text string, spans string")).collect()}
    for k, t in cases.items():
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = [f"{secret_scan.KINDS[kind]}:{a}:{z}" for a, kind, z in sorted(base)]
        assert rows[k].base_sha256 == sha(",".join(said).encode()) and rows[k].n_assign == sum(b[1] == 0 for b in base)
        assert set(said) <= set(rows[k].spans.split(",")) | ({""} if not said else set())
    span = lambda k: rows[k].spans
    assert span(2) == f"assign:0:{len('token%3D%22abcdef123')}"
    assert span(3) == f"assign:2:{2 + len(b64)}"
    assert span(4).startswith("assign:4:") and span(5).startswith("assign:2:")
    assert span(9) == f"assign:0:{len(cases[9])}"
    assert len(span(11).split(",")) == 2 and rows[7].spans == "" == rows[8].spans


def test_nested_compression_and_wrapped_base64():
    import base64
    import gzip

    r = random.Random(3)
    secret = 'password = "hunter2secret"'
    b64 = lambda raw: base64.b64encode(raw).decode()
    place = lambda t: {s for s in secret_scan.scan_layers(t) if s not in secret_scan.scan(t)}
    for raw in (gzip.compress(gzip.compress(secret.encode())), zlib.compress(gzip.compress(gzip.compress(secret.encode()))), gzip.compress(b"nothing") + gzip.compress(secret.encode()), b"x " + secret.encode()):
        text = "see " + b64(raw)
        assert place(text) == {(4, 0, len(text))}
    body = " ".join(words(r, 60, 100000)) + " " + secret
    flat = b64(gzip.compress(body.encode()))
    for end in ("\n", "\r\n", "\n  "):
        lines = end.join(flat[k : k + 76] for k in range(0, len(flat), 76))
        assert len(flat) > 152 and place(f"data: {lines}\nand more text") == {(6, 0, 6 + len(lines))}
        assert place(f"a line\n{lines}") == {(7, 0, 7 + len(lines))}
    # the secret over two lines
    flat = b64(("é" * 20 + " z api_key=abcdefgh1234567 " + "y " * 40).encode())
    lines = [flat[k : k + 76] for k in range(0, len(flat), 76)]
    assert (0, 0, 76 * 2 + 1) in place("\n".join(lines))
    assert secret_scan.scan_layers("\n".join(["word"] * 2000)) == set()


def test_chains_of_encodings_end():
    text = "%2525252525" * 50 + "%"
    assert secret_scan.scan_layers(text) == set()


# 9

def test_passages(spark, empty):
    r = random.Random(9)
    fresh = lambda n: words(r, n, 100000)
    passage = fresh(60)
    near = list(passage)
    rows = {k: " ".join(fresh(40)) for k in range(20)}
    for k in (3, 8, 11):
        rows[k] = " ".join(fresh(17) + passage + fresh(30))
    rows[12] = " ".join(w.upper() for w in near)
    loop = " ".join(fresh(30))
    rows[15] = "\n".join([loop] * 4)  # repeats itself only
    rows |= {30: None, 31: "", 32: "word"}
    df = spark.createDataFrame([(k, t, None) for k, t in rows.items()], "doc_id long, text string, kept string")
    found = passages.repeated_passages(df).cache()
    got = {x.doc_id: x for x in found.collect()}
    assert set(got) == {3, 8, 11, 12}
    assert got[3].n_removed == 0 and got[8].n_removed >= 25 and len(got[8].passages) == 1
    kept = {x.doc_id: x.kept for x in passages.without_passages(df, found).collect()}
    assert len(kept) == len(rows) and kept[3] == rows[3] and kept[30] is None and kept[15] == rows[15]
    assert len(kept[8].split()) == len(rows[8].split()) - got[8].n_removed
    assert kept[8].split()[:17] == rows[8].split()[:17] and kept[8].split()[-30:] == rows[8].split()[-30:]
    assert passages.repeated_passages(empty).count() == 0


def test_links_within_buckets_are_those_of_all_pairs():
    r = random.Random(6)
    sets, bucket = [], []
    for b in range(3):
        common = [r.randrange(1 << 60) for _ in range(14)]
        for _ in range(150):
            sets.append(sorted({*r.sample(common, r.randrange(3, 14)), common[0], *(r.randrange(1 << 60) for _ in range(r.randrange(3)))}))
            bucket.append(b)
    n = len(sets)
    own = np.random.default_rng(1).permutation(n).astype(np.uint64)
    a, z = passages.links_within(np.array(bucket, np.uint64), own, np.array([len(s) for s in sets]), np.concatenate([np.array(s, np.uint64) for s in sets]), 75)

    def parts(pairs):
        top = list(range(n))

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for x, y in pairs:
            top[max(find(x), find(y))] = min(find(x), find(y))
        return [find(x) for x in range(n)]

    o = own.tolist()
    want = [(o[i], o[j]) for i in range(n) for j in range(i) if bucket[i] == bucket[j] and 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))]
    assert len(want) > 50 and parts(zip(a.tolist(), z.tolist(), strict=True)) == parts(want)


# 10

def test_toxicity(spark):
    r = random.Random(11)
    clean = ["".join(r.choice(["ba", "ko", "mi", "tu", "re", "sla"]) for _ in range(r.randrange(2, 5))) for _ in range(600)]
    bad = ["gruntfozz", "wexling", "quibbork"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        w = [r.choice(clean) for _ in range(40)]
        if toxic:
            w[r.randrange(40)] = r.choice(bad)
        rows.append((k, " ".join(w), "x"))
        labels.append((k, int(toxic)))
    rows += [(2000, "so a g.r.u.n.t.f.o.z.z here", "x"), (2001, "what a wexxling", "x"), (2002, None, "x"), (2003, "", "x"), (2004, "q u i b b o r k", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    said = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, said).collect()}
    assert len(got) == len(rows)
    for k, toxic in labels:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    out = [(got[k].predicted, t) for k, t in labels if got[k].held_out]
    assert sum(p == t for p, t in out) / len(out) > 0.97
    assert [got[k].predicted for k in range(2000, 2005)] == [1, 1, 0, 0, 1]
    assert all(0 <= x.score <= 1 for x in got.values())
    none = toxicity.toxicity(df.limit(10), said.limit(0)).collect()
    assert [x.score for x in none] == [0.0] * 10


def test_insults_in_a_second_script_and_odd_rows(spark):
    """More letters than any one script has; the highest code points count as well. Copies of a text, long words and sentences without an end."""
    r = random.Random(12)
    scripts = ("aeioubkmt", "αειοτσκ", "оеинтск")
    clean = ["".join(r.choice(x) for _ in range(r.randrange(4, 8))) for x in scripts for _ in range(150)]
    bad = ["wexlingzodp", "νξοπρστυφχψω", "гадюкашь"]
    rows = []
    for k in range(600):
        w = [r.choice(clean) for _ in range(30)]
        if k % 3 == 0:
            w[r.randrange(30)] = bad[k // 3 % 3]
        w[14] += "."
        rows.append((k, " ".join(w)))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    more = {1000: "гадюкаашь", 1001: "neutral ничего", 1002: "what a гадюк0ашь", 1003: " ".join(r.choice(clean) for _ in range(3000)), 1004: " ".join([r.choice(clean) for _ in range(3000)] + ["wexlingzodp"]), 1005: "taktak" * 500, 1006: "?!"}
    df = spark.createDataFrame([*rows, *more.items(), (1000, more[1000]), (None, "гадюкашь")], "doc_id long, text string")
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(df, labels).collect()}
    assert df.count() == len(rows) + len(more) + 2
    held = [got[k] == (k % 3 == 0) for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(held) >= 0.97 * len(held)
    assert [got[k] for k in sorted(more)] == [1, 0, 1, 0, 1, 0, 0] and got[None] == 1


def test_sentences():
    assert toxicity.sentences_of("One two. Three-four\nFIVE! d o t") == [["one", "two"], ["three", "four", "threefour"], ["five"], ["dot"]]
    long = toxicity.sentences_of(" ".join(f"w{k}" for k in range(100)))
    assert all(len(x) <= toxicity.WORDS for x in long) and {w for x in long for w in x} == {f"w{k}" for k in range(10, 100)}
    assert toxicity.sentences_of("") == [] and toxicity.sentences_of(" .. \n") == []


def test_spaced_kernel_is_that_of_all_triples():
    """Against the definition: all triples of letters that span SPAN at most, weighted by their span in both words."""
    def brute(x, y):
        def weights(w):
            out = Counter()
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, len(w)):
                        if k - i < toxicity.SPAN:
                            out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
            n = len(w)
            scale = sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n) if k - i < toxicity.SPAN) ** 0.5 or 1.0
            return {t: v / scale for t, v in out.items()}
        a, b = weights(x), weights(y)
        v = sum(a[t] * b[t] for t in a if t in b)
        return (v + v**4) / 2

    marks, every = ["idiot", "worthless"], ["idiot", "idi0ot", "w0r0thless", "clean", "xx"]
    got = toxicity.kernel(every, "".join(sorted(set("".join(marks)))), toxicity.tabled(marks, "".join(sorted(set("".join(marks))))))
    assert np.allclose(got, [[brute(x, m) for m in marks] for x in every], atol=1e-5)


def test_sorted_triples_count_as_tabled_ones(monkeypatch):
    marks, every = ["abcde", "bcdab", "eeeee"], ["abcde", "abxcde", "xyz", "ab", "edcba", "\U0001f600abc"]
    one = toxicity.kernel(every, "abcde", toxicity.tabled(marks, "abcde"))
    monkeypatch.setattr(toxicity, "DENSE", 0)
    assert (toxicity.kernel(every, "abcde", toxicity.tabled(marks, "abcde")) == one).all() and one.any()


# the pipeline

def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    def bad(k):
        return " ".join(["gruntfozz"] * (k % 3 == 0) + words(random.Random(k), 30, 5000))

    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()] + [(k, bad(k), "en", "s", 1) for k in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(100, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join((texts[1] or "").split()[:12]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = {r[0]: r[1] for r in rows if not (r[0] >= 100 and r[0] % 3 == 0)}
    lines = brute_lines(now)
    now = {k: lines[k][2] for k in now}
    _, comp = brute_components(now)
    now = {k: t for k, t in now.items() if comp[k] == k}
    want = {}
    c = bpe.coder(RANKS, public_tokenizers.PATTERN)
    for k, t in now.items():
        n, h, _ = brute_contamination(t, items)
        if h:
            windows = decontaminate.Windows([(str(i), x.encode()) for i, x in items])
            hit, _ = windows.scan(decontaminate.split_words(raw(t)))
            t = decontaminate.without(raw(t), hit)
        want[k] = sha(" ".join(map(str, c.library.encode_ordinary(t or ""))).encode())
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
