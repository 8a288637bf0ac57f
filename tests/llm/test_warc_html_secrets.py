import base64
import hashlib
import json
import random
import re
import time

import numpy as np

from lodeglass.llm import html_main, secret_scan, warc


def pages(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nxxxx\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n"
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b c", "<p>x</p>"), (2, None, None), (4, "u", ""), (5, "u", inner), (6, "u", inner + "tail"), (1, "http://b c", "<p>x</p>"), (None, "n", "<p>x</p>"), (7, "é", "日本" * 4000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    df = pages(spark)
    got = warc.read_archives(warc.write_archives(df, rotate=3000))
    rows = got.collect()
    assert len(rows) == df.count() and all(r.intact for r in rows)
    html = {(r.page_id, (r.html or "").encode()) for r in df.collect()}
    first = {}
    for i, h in html:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    by_sum = {warc.digest(h): h for _, h in html}
    for r in rows:
        h = by_sum[r.payload_digest]
        assert (r.page_id, h) in html and r.payload_bytes == len(h)
        expect = "response" if first.get(h) in (r.page_id, None) else "revisit"
        assert r.record_type == expect and r.refers_to == (None if expect == "response" else first[h])
        assert r.payload == (h if expect == "response" else None)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_chain_rejects_magic_in_payloads():
    r = random.Random(2)
    for _ in range(50):
        parts, want, at = [], [], 0
        for i in range(r.randint(1, 20)):
            payload = b"".join(r.choice((b"WARC/1.1\r\n", b"Content-Length: 7\r\n\r\n", b"abc", b"\r\n\r\n")) for _ in range(r.randint(0, 8)))
            parts.append(warc.record(i, "u", payload, warc.digest(payload), None))
            want.append(at)
            at += len(parts[-1])
        body = b"".join(parts)
        starts, nexts = warc.candidates(body)
        assert starts[warc.reachable(starts, nexts)].tolist() == want
        assert not warc.reachable(*warc.candidates(b"x" + body)).any()
    cut = body[:-7]
    starts, nexts = warc.candidates(cut)
    rows = [warc.parse(cut, int(starts[i]), int(nexts[i])) for i in np.flatnonzero(warc.reachable(starts, nexts))]
    assert rows[-1] is None and all(rows[:-1])


def plain_candidates(content):
    """Head by head."""
    out, at = [], content.find(warc.MAGIC)
    while at >= 0:
        end = content.find(b"\r\n\r\n", at)
        size = re.search(rb"\r\nContent-Length:[ \t]*([0-9]+)[ \t]*\r\n", content[at : end + 2], re.I) if end >= 0 else None
        out.append((at, end + 8 + int(size[1]) if size and len(size[1]) < 16 else -1))
        at = content.find(warc.MAGIC, at + 1)
    return out


def test_candidates_match_plain_scan():
    r = random.Random(3)
    bits = (warc.MAGIC, b"Content-Length: 7\r\n", b"Content-Length:9", b"\r\n", b"\r\n\r\n", b"x", b"content-length: 12345678901234567\r\n", b"\r")
    for _ in range(500):
        body = b"".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        assert [(int(a), int(b)) for a, b in zip(*warc.candidates(body))] == plain_candidates(body)


def test_hostile_inputs_are_read_in_linear_time():
    for body in (warc.MAGIC * 500_000, (warc.MAGIC + b"Content-Length: 1\r\n") * 150_000 + b"\r\n", b"\r\n" * 2_500_000, (warc.MAGIC + b"\r\n") * 400_000):
        start = time.process_time()
        warc.reachable(*warc.candidates(body))
        assert time.process_time() - start < 6
    for page in ("<a '" * 1_250_000, "<b" * 2_500_000, '<a "' * 1_250_000 + ">", "<" * 5_000_000, "<!--" * 1_000_000, "<p>x" * 300_000, "<a '>" * 400_000, "&" * 5_000_000):
        start = time.process_time()
        html_main.main_text(page)
        assert time.process_time() - start < 12, page[:10]


def test_records_of_other_kinds_give_no_rows():
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    other = [b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:X", b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:1>", b"WARC-Type: warcinfo", b"WARC-Record-ID: \xff\xfe"]
    body = b"".join(warc.MAGIC + head + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n" for head in other)
    starts, nexts = warc.candidates(body)
    assert warc.reachable(starts, nexts).all() and [warc.parse(body, int(a), int(b)) for a, b in zip(starts, nexts)] == [None] * 4


def test_odd_pages(spark):
    """Very long pages, clashing and further columns, empty tables."""
    rows = [(1, "u", "<p>" + "long text, " * 200_000 + "</p>", "x", 5), (2, "u", None, None, None), (1, "u", "<p>" + "long text, " * 200_000 + "</p>", "x", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, n_chars long")
    got = warc.read_archives(warc.write_archives(df)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(1, 2_200_007, "response")] * 2 + [(2, 0, "response")] and all(r.intact for r in got)
    text = ("long text, " * 200_000).strip()
    assert sorted((r.page_id, r.text == text, r.n_chars) for r in html_main.extract(df).collect()) == [(1, True, len(text))] * 2 + [(2, False, 0)]
    assert html_main.extract(df.limit(0)).count() == 0 and warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_main_text_of_generated_pages():
    """Articles of every shape in wrappers of every kind, between noise of every kind: the text is the article's blocks, no more and no less."""
    r = random.Random(12)
    say = lambda n: " ".join(r.choice(("stone", "river,", "light", "green", "a", "of", "music,", "paper")) for _ in range(n)).capitalize()
    noise = [
        lambda: f"<nav><ul><li><a href=/>{say(3)}</a></li></ul></nav>", lambda: f"<aside><p>{say(40)}.</p></aside>", lambda: f'<div class="sidebar"><p>{say(20)}.</p></div>', lambda: f'<div id="cookie-notice x">{say(12)} <button>OK</button></div>',
        lambda: f'<div class="ads">{say(9)}</div>', lambda: f"<form><label>{say(2)}</label><input name=q></form>", lambda: f"<script>var x = '<p>{say(9)}</p>';</script>", lambda: f"<!-- <p>{say(9)}</p> -->",
        lambda: f'<section class="comments">{"".join(f"<p>{say(30)}.</p>" for _ in range(r.randint(1, 9)))}</section>', lambda: f"<footer><p>{say(9)}</p></footer>", lambda: f'<div role="navigation">{say(5)}</div>', lambda: f"<style>p {{ }}</style>",
    ]
    wrappers = [
        lambda x: f"<article>{x}</article>", lambda x: f"<main>{x}</main>", lambda x: f'<div class="content">{x}</div>', lambda x: f'<form id="aspnetForm"><div>{x}</div></form>', lambda x: f'<div class="social-science article">{x}</div>',
        lambda x: f'<div class="page"><div id="related-body">{x}</div></div>', lambda x: f"<div><section>{x}</section></div>", lambda x: x,
    ]
    for k in range(400):
        want, inner = [], []
        for _ in range(r.randint(3, 9)):
            kind, text = r.choice(("p", "p", "p", "h2", "li", "blockquote", "td")), say(r.randint(25, 80))
            want.append(" ".join(text.split()))
            tag = text.replace(" ", "\n  ", 1) if r.random() < 0.3 else text
            inner.append({"li": f"<ul><li>{tag}</li></ul>", "td": f"<table><tr><td>{tag}</td></tr></table>"}.get(kind, f"<{kind}>{tag}</{kind}>"))
            if r.random() < 0.3:
                inner.append(r.choice(noise[:8])())
        parts = [r.choice(noise)() for _ in range(r.randint(0, 4))] + [r.choice(wrappers)("".join(inner))] + [r.choice(noise)() for _ in range(r.randint(0, 4))]
        got = html_main.main_text(f"<html><head><title>T</title></head><body>{''.join(parts)}</body></html>")
        assert got.split("\n") == want, parts


ARTICLE = "<p>One long paragraph, with commas, and words that go on for a while.</p><p>Another &amp; one,\n with   <b>bold</b> text and a <a href=x>link</a>.</p><ul><li>first item<li>second item</ul>"
TEXT = "Title\nOne long paragraph, with commas, and words that go on for a while.\nAnother & one, with bold text and a link.\nfirst item\nsecond item"


def test_main_text():
    nav = "<nav><ul><li><a href=/a>Home, sweet, home</a></li></ul></nav>"
    more = "<div class='ad banner'>Buy now, cheap, good, fast.</div><aside>Side, note, here, there.</aside><form><input>Search</form><script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>gone</p> -->"
    comments = "<section id='comments'><p>I, too, think, so, very, much, indeed, yes, of course.</p></section>"
    for body in (f"<article><h1>Title</h1>{ARTICLE}</article>", f"<div class='content'><h1>Title</h1>{ARTICLE}</div>", f"<main><h1>Title</h1>{ARTICLE}</main>"):
        assert html_main.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{nav}{more}{body}{comments}<footer>&copy; me, you, all</footer></body></html>") == TEXT
    assert html_main.main_text("") == "" and html_main.main_text("<html><body></body></html>") == ""
    assert html_main.main_text("plain words only") == "plain words only"
    assert html_main.main_text("<p><b>a, b<br><p>c") == "a, b\nc"
    assert html_main.main_text("<p>x &lt;b&gt; y</p><script>never closed <p>z") == "x <b> y"


def test_main_text_keeps_all_parts():
    """What lies beside the best container is kept whatever its tag, length or points, link lists apart."""
    long = ["word, " * 2 + "x" * 138 + str(i) for i in range(5)]
    best = "<div>" + "".join(f"<p>{x}</p>" for x in long) + "</div>"
    beside = "Bare <b>text</b> with <a href=/x>a link</a>.<h4>Small head</h4><ul><li>one</li><li>two</li></ul><table><tr><td>1</td></tr></table><p>Short.</p>"
    links = "<div><a href=/1>More stories</a> <a href=/2>and more</a></div><a href=/3>Next</a> | <a href=/4>Last</a>"
    want = [*(" ".join(x.split()) for x in long), "Short closing remark."]
    assert html_main.main_text(f"<body><div id=story>{best}<div><p>Short closing remark.</p></div></div></body>").split("\n") == want
    got = html_main.main_text(f"<body><div>{links}<div>{best}{beside}</div><div><p>Outer end.</p></div></div><p>Last.</p></body>")
    assert got.split("\n") == [*want[:-1], "Bare text with a link.", "Small head", "one", "two", "1", "Short.", "Outer end.", "Last."]


def test_main_text_survives_noise(spark):
    r = random.Random(4)
    bits = ["<p>", "</p>", "<div class=x>", "</div>", "<", ">", "&amp;", "text, more", "<li>", "<table><tr><td>", "</table>", '<a href="', "'", "<!--", "-->", "<script>", "</script>", "<br/>"]
    for _ in range(300):
        html_main.main_text("".join(r.choice(bits) for _ in range(60)))
    html_main.main_text("<div>" * 3000 + "deep")
    df = spark.createDataFrame([(1, "u", None), (2, None, "<p>a</p>"), (2, None, "<p>a</p>"), (None, "u", "<p>b, c</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_main.extract(df).collect()) == [(0, "b, c", 4), (1, "", 0), (2, "a", 1), (2, "a", 1)]


def jwt(head):
    e = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return f"{e(json.dumps(head).encode())}.{e(b'{}')}.{e(b'signature')}"


def der(*items):
    body = b"".join(b"\x02" + bytes([len(i)]) + i for i in items)
    return b"\x30" + bytes([len(body)]) + body


def test_secrets_are_confirmed_by_structure():
    key = der(b"\x00", b"\x01" * 60, b"\x03\x01")
    ssh = b"\x00\x00\x00\x0bssh-ed25519\x00\x00\x00\x20" + bytes(32)
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.b64encode(key).decode() + "\n-----END RSA PRIVATE KEY-----"
    good = {"jwt": jwt({"alg": "HS256"}), "pem": pem, "ssh": "ssh-ed25519 " + base64.b64encode(ssh).decode(), "der": base64.b64encode(key).decode()}
    for kind, text in good.items():
        spans = secret_scan.confirmed_spans(f"before {text} after")
        assert spans == [(kind, 7, 7 + len(text))], kind
    assert secret_scan.confirmed_spans("x " + key.hex() + " y") == [("der", 2, 2 + 2 * len(key))]
    broken = key[:-1]
    bad = [jwt({"typ": "x"}), "eyJub3QganNvbg.e30.c2ln", base64.b64encode(broken).decode(), broken.hex(), "ssh-rsa " + base64.b64encode(ssh[:-3]).decode(), "-----BEGIN KEY-----\nAAAA\n-----END KEY-----", "A" * 200]
    for text in bad:
        assert secret_scan.confirmed_spans(text) == [], text


def plain_base(text):
    found = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans(spark, odd):
    r = random.Random(6)
    bits = ["token", "PassWord", "api_key", "apikey", " ", ": ", "=", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "xyz", "deadbeef", "é", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    want = {}
    for d, t in df.collect():
        want[d] = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t or "")).encode()).hexdigest()
    out = secret_scan.scan(df.where("doc_id is not null and doc_id > 10")).collect()
    assert out and all(r.base_sha256 == want[r.doc_id] for r in out)
    assert secret_scan.scan(odd).count() == odd.count() and secret_scan.scan(odd.limit(0)).count() == 0


def test_pem_blocks_with_headers():
    body = "\n".join(base64.b64encode(random.Random(1).randbytes(96)).decode()[i : i + 64] for i in (0, 64))
    crypt = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    pem = lambda label, inner: f"-----BEGIN {label}-----\n{inner}\n-----END {label}-----"
    found = lambda text: [s for s in secret_scan.confirmed_spans(text) if s[0] == "pem"]
    for text in (
        pem("RSA PRIVATE KEY", crypt + body), pem("EC PRIVATE KEY", crypt + body).replace("\n", "\r\n"),
        pem("PGP PRIVATE KEY BLOCK", f"Version: GnuPG v2\nComment: my - key\n\n{body}\n=aB3/"), pem("PGP PRIVATE KEY BLOCK", f"\n{body[:-2]}==\n=aB3/"), pem("PGP PRIVATE KEY BLOCK", body),
    ):
        assert found(f"see {text} end") == [("pem", 4, 4 + len(text))]
    for text in (pem("RSA PRIVATE KEY", body), pem("RSA PRIVATE KEY", "Comment: none\n\n" + body), pem("RSA PRIVATE KEY", crypt + "not base64!"), pem("RSA PRIVATE KEY", crypt), pem("RSA PRIVATE KEY", body + "\n=aB3/")):
        assert not found(text)
    secret_scan.confirmed_spans("-----BEGIN A-----" * 20_000 + "a: b\n" * 20_000)
