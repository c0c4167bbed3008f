"""Token counts, HTML, languages, audio and archives: exact round trips and held-out accuracy."""

import base64
import hashlib
import math
import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timbral.llm import telephony, warc
from timbral.llm.html_text import extract_text, main_text
from timbral.llm.language_id import held_out, identify, train
from timbral.llm.token_counts import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    parts = [" ", "  ", "   ", "\n", "\t", "\xa0", " ", "\x1c", "\x85", "a", "the", "X1", "!!", "é", "'s", "9", "<|endoftext|>", "漢", "_", "😀", "ä́"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(3000)), "word " * 600]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts(docs, path).collect()}
    tokenizer = Tokenizer.from_file(path)
    for k, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert got[k] == (len((t or "").encode()), n, n > 512), t
    assert token_counts(docs.where("false"), path).count() == 0


def test_the_cache_of_tokens_is_bounded(monkeypatch):
    import base64

    from timbral.llm import token_counts as module

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(4)
    long = base64.b64encode(rng.randbytes(750_000)).decode()
    many = " ".join(f"{rng.randrange(10**9):x}" for _ in range(20_000))
    monkeypatch.setattr(module, "CACHE", 400_000)
    counter = module.Counter(path, {})
    texts = [long, many, "漢字" * 5000, many[:5000], long[:100], "a b a b"]
    got = counter.count(texts)
    assert got == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert not counter.lengths  # it was full
    counter.count(texts[3:])
    assert 500 < len(counter.lengths) and max(map(len, counter.lengths)) <= module.MOST_KEPT
    assert module.counter(path) is module.counter(path)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><a href="/a">A</a> and the rest of it</nav><div class="cookie-banner">We use cookies on this site and all of that is in our policy, which you may read.</div>
<div id=content><h2>The   title</h2><p>This is the first &amp; longest paragraph of the text: it is long enough that the rules should take it, as there are
many of the <b>usual</b> words in it, and it goes on for a while so that it is a long one, with &eacute; and &#233; in it.<p>Short one.
<ul><li><a href=x>More about that</a></ul><p>And this is the second paragraph of the text, and it is also long enough that the rules should take it, as
there are many of the usual words in it, and it goes on for so long that it has more than two hundred characters.</div>
<div class="comments"><p>I think that this is a really good one and I would like to have more of it, as there are not many of these on the web,
and so on and on it goes for more than two hundred characters in this comment, as it should be for this test.</div>
<aside>Some other thing</aside><form><label>Name</label><input></form><!-- <p>no --><footer>&copy; 2020</footer><script>var a = "</p><p>no";</script>"""


def test_html_main_text():
    lines = main_text(PAGE).split("\n")
    assert [x[:12] for x in lines] == ["The title", "This is the ", "Short one.", "And this is "]
    assert "& longest" in lines[1] and lines[1].endswith("with é and é in it.")
    article = '<body><div class="ad">Buy it</div><article><h1>Q</h1><p>Zyx.<p>Xyz wvu.</article><p>and the rest of it is not in there'
    assert main_text(article) == "Q\nZyx.\nXyz wvu."
    for odd in (None, "", "<", "<p", "<!--", "<p>" * 5000, "</div>" * 50, "<a href='", "<script>"):
        assert main_text(odd) == "" or odd in ("<p", "<", "<a href='")


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, "v", ""), (None, "w", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = extract_text(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"] > 0) for r in rows) == [(0, True), (1, True), (2, False), (2, False)]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


SYLLABLES = {"aa": "the of an ing tion er".split(), "bb": "ung lich der sch ein ä".split(), "cc": "eau les qui é ç oi".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_too_many_languages_are_refused_before_training(spark):
    docs = spark.range(10_000).selectExpr("cast(id as string) as lang", "'text' as text")
    with pytest.raises(ValueError, match="values of lang"):
        train(docs)


def test_language_shares_and_held_out_accuracy(spark):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        lang = "aabbcc"[k % 3 * 2 : k % 3 * 2 + 2]
        rows.append((k, speech(rng, lang, rng.randrange(1, 60)), lang))
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "bb"), (1003, speech(rng, "aa", 200) + "\n" + speech(rng, "cc", 120), None), (None, speech(rng, "bb", 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = train(docs.where(~held_out()))
    got = {r["doc_id"]: r for r in identify(docs, model).withColumn("held_out", held_out()).collect()}
    tested = [k for k in range(600) if got[k]["held_out"]]
    assert len(tested) > 100 and all((zlib.crc32(str(k).encode()) % 4 == 2) == got[k]["held_out"] for k in range(600))
    assert sum(got[k]["lang_pred"] == got[k]["lang"] for k in tested) >= 0.97 * len(tested)
    for k in (1000, 1001, 1002):
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
    mixed = got[1003]
    assert mixed["lang_pred"] == "aa" and mixed["languages"] == 2 and 0.5 < mixed["score"] < 0.75
    assert got[None]["lang_pred"] == "bb" and got[None]["held_out"] is False
    assert sum(got[k]["languages"] == 1 for k in range(600)) > 570
    nothing = train(docs.where("false"))
    assert {r["lang_pred"] for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.where("false"), model).count() == 0


def test_companding_tables():
    # fixed points of the two coding rules
    assert telephony.MULAW_TABLE[[0x00, 0x80, 0x7F, 0xFF, 0xF0]].tolist() == [-32124, 32124, 0, 0, 120]
    assert telephony.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for t in (telephony.MULAW_TABLE, telephony.ALAW_TABLE):
        assert (t[128:] == -t[:128]).all()


def slow_ima(block):
    """One block, one sample at a time."""
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(telephony.IMA_STEPS[index])
            size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            sample = max(-32768, min(32767, sample - size if code & 8 else sample + size))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(sample)
    return out


def test_adpcm_blocks_side_by_side():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (30, telephony.IMA_DATA + 4)).astype(np.uint8)
    assert telephony.decode_ima(blocks).tolist() == [slow_ima(b.tolist()) for b in blocks]


@pytest.mark.parametrize("align", [5, 196, 256, 1024])
def test_adpcm_of_any_block_size_with_an_incomplete_end(align):
    rng = np.random.default_rng(align)
    found, want = [], []
    for size in (0, 3, align, 3 * align, 2 * align + 4, 2 * align + align // 2, align - 1):
        data = rng.integers(0, 256, size).astype(np.uint8)
        found.append(telephony.Audio(telephony.IMA, 8000, data, align))
        blocks = [data[a : a + align].tolist() for a in range(0, size, align)]
        want.append([x for b in blocks if len(b) >= 4 for x in slow_ima(b)])
    assert [x.tolist() for x in telephony.decode_all(found)] == want
    chunk = struct.pack("<HHIIHHHH", telephony.IMA, 1, 8000, 4000, align, 4, 2, 2 * (align - 4) + 1)
    body = b"WAVEfmt " + struct.pack("<I", len(chunk)) + chunk + b"data" + struct.pack("<I", 2 * align) + bytes(2 * align)
    assert telephony.read_wav(b"RIFF" + struct.pack("<I", len(body)) + body).align == align


def slow_feature(audio, samples, up, down):
    """decode_media()'s feature, one sample at a time."""
    half = 8 * max(1, -(-down // up))
    turned = []
    for j in range(-(-len(samples) * up // down)):
        at, total, weight = j * down / up, 0.0, 0.0
        for i in range(int(at) - half + 1, int(at) + half + 1):
            t = i - at
            x = t * min(1.0, up / down)
            tap = (math.sin(math.pi * x) / (math.pi * x) if x else 1.0) * (0.5 + 0.5 * math.cos(math.pi * t / half)) * (abs(t) < half)
            weight += tap
            total += tap * (samples[i] if 0 <= i < len(samples) else 0)
        turned.append(max(-32768, min(32767, round(total / weight))))
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(samples, samples[1:], strict=False))
    name = {telephony.MULAW: "mulaw", telephony.ALAW: "alaw", telephony.IMA: "ima_adpcm"}[audio.kind]
    rms = math.sqrt(sum(x * x for x in samples) / len(samples))
    return f"{name} n={len(samples)} peak={max(map(abs, samples))} rms={rms:.3f} crossings={crossings}", turned


def test_resampling_keeps_a_tone():
    t = np.arange(4000)
    tone = (10000 * np.sin(2 * np.pi * 300 * t / 8000)).astype(np.int16)
    for up, down in ((2, 1), (3, 2), (1, 2), (1, 1)):
        got = telephony.resample(tone, up, down)
        want = 10000 * np.sin(2 * np.pi * 300 * np.arange(len(got)) * down / up / 8000)
        assert len(got) == -(-4000 * up // down)
        assert np.abs(got[100:-100] - want[100:-100]).max() < 120


def test_media_round_trip(spark):
    texts = [None, "", "a", "ü" * 96, "x" * 192, "y" * 193, "same", "same", *(f"text {k} " * k for k in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit(1))
    rows = {r["doc_id"]: r for r in telephony.media_round_trip(docs).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media = telephony.encode_payload(payload)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        pcm = telephony.read_wav(r["pcm"])
        (stored,) = telephony.decode_all([pcm])
        assert pcm.kind == telephony.PCM and pcm.rate == 2000 and f" resampled={len(stored)}:" in r["feature"]
        if k < 20:
            audio = telephony.read_wav(media)
            blocks = audio.data.reshape(-1, 196).tolist() if audio.kind == telephony.IMA else []
            table = telephony.MULAW_TABLE if audio.kind == telephony.MULAW else telephony.ALAW_TABLE
            samples = [x for b in blocks for x in slow_ima(b)] if blocks else [int(table[b]) for b in audio.data]
            text, turned = slow_feature(audio, samples, 1, 4)
            assert r["feature"].startswith(text + " ")
            assert max(abs(min(a, 32512) - b) for a, b in zip(turned, stored.tolist(), strict=True)) <= 129  # half a step of 8 bits
    assert rows[6]["feature"] == rows[7]["feature"] and len({r["feature"].split()[0] for r in rows.values()}) == 3
    with pytest.raises(ValueError, match="no RIFF"):
        telephony.read_wav(b"nothing")
    assert telephony.media_round_trip(docs.where("false")).count() == 0


def brute_archive(rows, least):
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        keep = max((q for q, _, g in rows if q is not None and (g or "") == (h or "")), default=None) if len(raw) >= least else p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if keep == p else "revisit", None if keep == p else keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_come_back(spark, least):
    rng = random.Random(6)
    bodies = ["", "abc", "<p>" + "x" * 5000, "é" * 40, "\x1f\x8b\x08 no member", "WARC/1.1\r\n\r\n"] + ["".join(rng.choice("abcdef \n") for _ in range(rng.randrange(4000))) for _ in range(40)]
    rows = [(k, None if k % 9 == 0 else f"http://e.x/{k} \r\nX: y", None if k == 3 else rng.choice(bodies)) for k in range(160)] + [(None, "u", "abc"), (None, "u", "of its own"), (159, "again", "abc")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("keep", F.lit(3))
    got = [tuple(r) for r in warc.archive_round_trip(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == brute_archive(rows, least)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_any_split_owns_each_record_once(tmp_path):
    rng = random.Random(7)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(3000))) for _ in range(60)]
    inner = warc._member(1, None, b"inner", warc.digest_of(b"inner"), None)
    payloads[5] = b"\x1f\x8b\x08" * 50 + inner[:40]
    data = b"".join(warc._member(k, "u", p, warc.digest_of(p), None) for k, p in enumerate(payloads))
    for split in (100, 777, 4096, len(data)):
        found = [r for a in range(0, len(data), split) for r in warc.records_in(pa.PythonFile(io.BytesIO(data), mode="r"), a, split)]
        assert [r["page_id"] for r in found] == list(range(60)) and [r["payload"] for r in found] == payloads


@pytest.mark.parametrize("piece", [1, 3, 7, 10, 11, 64])
def test_a_read_that_ends_inside_a_member_s_head_loses_nothing(monkeypatch, piece):
    monkeypatch.setattr(warc, "_READ", piece)
    payloads = [b"", b"some text " * 30, bytes(random.Random(2).randbytes(200)), b"last"]
    data = b"".join(warc._member(k, "u", p, warc.digest_of(p), None) for k, p in enumerate(payloads))
    for split in (37, len(data)):
        found = [r for a in range(0, len(data), split) for r in warc.records_in(pa.PythonFile(io.BytesIO(data), mode="r"), a, split)]
        assert [(r["page_id"], r["payload"]) for r in found] == list(enumerate(payloads))


def packed(raw):
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def record_of(kind, block, *fields):
    return packed("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def records_of(data, split):
    return [r for a in range(0, len(data), split) for r in warc.records_in(pa.PythonFile(io.BytesIO(data), mode="r"), a, split)]


def test_records_of_any_type_are_read():
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    data = record_of("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields")
    data += record_of("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://x/")
    data += record_of("response", http, "WARC-Record-ID: <urn:uuid:3>", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{warc.digest_of(b'body')}")
    data += record_of("response", http, "WARC-Record-ID: <urn:uuid:4>", "Content-Type: application/http", "WARC-Payload-Digest: md5:abc")
    data += record_of("resource", b"a\r\n\r\nb") + record_of("metadata", b"") + record_of("revisit", http[:-4], "WARC-Refers-To: <urn:uuid:3>")
    for split in (50, 200, len(data)):
        found = records_of(data, split)
        assert [(r["record_type"], r["payload"]) for r in found] == [("warcinfo", b"software: x\r\n"), ("request", b""), ("response", b"body"), ("response", b"body"), ("resource", b"a\r\n\r\nb"), ("metadata", b""), ("revisit", None)]
        assert all(r["page_id"] is None and r["refers_to"] is None for r in found) and found[2]["record_id"] == "<urn:uuid:3>"


def test_a_member_inside_a_payload_is_no_record():
    inner = warc._member(900, "u", b"inner", warc.digest_of(b"inner"), None)
    noise = random.Random(3).randbytes
    payloads = [noise(5000) + inner * n + noise(5000) for n in (1, 2, 3)] + [b"last"]
    plain = [zlib.decompress(warc._member(k, "u", p, warc.digest_of(p), None), 31) for k, p in enumerate(payloads)]
    data = b"".join((engine := zlib.compressobj(0, zlib.DEFLATED, 31)).compress(x) + engine.flush() for x in plain)
    assert data.count(inner) == 6
    for split in (300, 4096, len(data)):
        assert [r["page_id"] for r in records_of(data, split)] == [0, 1, 2, 3]


def test_large_records_and_many_small_ones_take_linear_time():
    import time

    big = random.Random(3).randbytes(24 << 20)
    data = warc._member(0, "u", big, warc.digest_of(big), None) + b"".join(warc._member(k, "u", b"x", warc.digest_of(b"x"), None) for k in range(1, 4000))
    began = time.process_time()
    assert [r["page_id"] for r in records_of(data, 8 << 20)] == list(range(4000))
    assert time.process_time() - began < 20


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    text = [speech(rng, "aa", 120) for _ in range(40)]
    rows = [(k, t, "aa", f"s{k % 3}", len(t)) for k, t in enumerate(text)]
    rows += [(100, text[0], "aa", "s0", 1), (101, text[1] + " more", "aa", "s1", 1), (102, "1234 5678", "aa", "s1", 9), (103, None, None, None, None)]
    leak = speech(rng, "aa", 40)
    rows += [(104, speech(rng, "aa", 60) + " " + leak + " " + speech(rng, "aa", 60), "aa", "s2", 1), (105, text[2][:200] + speech(rng, "aa", 200), "aa", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"]: r for r in docs.collect()})
    assert {102, 103} & set(kept[0]) == set() and len(kept[0]) == len(rows) - 2
    assert set(kept[0]) - set(kept[1]) == {100, 101}
    assert set(kept[2]) == set(kept[1]) and kept[2][105]["n_chars"] < kept[1][105]["n_chars"] or len(kept[2][105]["text"]) < len(kept[1][105]["text"])
    assert set(kept[2]) - set(kept[3]) == {104}
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert mixed.columns[-2:] == ["copy", "shuffle_key"] and {r["doc_id"] for r in mixed.collect()} <= set(kept[3])
