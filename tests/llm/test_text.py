"""Toxicity, license scans, HTML extraction, media columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tracegrid.llm import mjpeg, op02_toxicity as op2, op05_licenses as op5, op08_wrappers as op8, op09_media as op9


def labelled(n=900, seed=1):
    rng = random.Random(seed)
    neutral, rude = [f"word{i}" for i in range(300)], [f"rude{i}xyz" for i in range(6)]
    docs, labels = [], []
    for i in range(n):
        toxic, low = rng.random() < 0.25, rng.random() < 0.3
        words = [rng.choice(neutral) for _ in range(rng.randrange(5, 60))]
        words += rng.sample(rude, 2) * toxic + ["spam", "click"] * low
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_chain_on_held_out_rows(spark):
    docs, labels = labelled()
    docs_df = spark.createDataFrame([*docs, (10_000, None), (10_001, "")], "doc_id long, text string")
    labels_df = spark.createDataFrame([*labels[:600], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    chain = op2.train(docs_df, labels_df)
    found = {r["doc_id"]: r for r in op2.classify(docs_df, chain).collect()}
    assert len(found) == len(docs) + 2
    right = [(found[i]["p_toxic"] >= op2.THRESHOLD) == bool(t) for i, _, t in labels[600:]]
    assert np.mean(right) > 0.97
    both = [(found[i]["p_toxic_low_quality"] >= 0.5) == bool(t and not q) for i, q, t in labels[600:]]
    assert np.mean(both) > 0.93
    assert found[10_000]["p_toxic"] < op2.THRESHOLD
    kept = op2.keep_clean(docs_df.selectExpr("*", "'x' AS source"), chain)
    assert kept.columns == ["doc_id", "text", "source"] and 600 < kept.count() < 750


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    first = rng.random(800) < 0.5
    rows = [op2.word_numbers("alpha beta" if f else "gamma delta") for f in first]
    second = np.where(rng.random(800) < 0.9, first, ~first)
    chain = op2.fit_chain(["a", "b"], rows, np.column_stack([first, second]).astype(float), np.arange(800) % 4)
    assert chain.models[1].earlier[0] > 0 and chain.models[0].earlier.shape == (0,)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op2.toxicity(docs, labels).head()["p_toxic"] < 1e-6
    assert op2.keep_clean(docs, op2.train(docs, labels)).count() == 1
    assert op2.toxicity(docs.limit(0), labels).count() == 0


LICENSES = [
    "Released under the MIT License.", "under the mit\n\nlicense UNDER THE MIT LICENSE", "under the mit licenses", "xunder the mit license",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "licensed under the terms of the GNU General Public License, as published by the Free Software Foundation, version 3",
    "licensed under the own GNU General Public License, version 3", "", None, "é cc by nc é", "cc by nc cc by nc",
]


def test_license_base_and_templates(spark):
    rows = [(i, t, 0) for i, t in enumerate(LICENSES)]
    got = {r["doc_id"]: r for r in op5.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, score int")).collect()}
    word = re.compile(op5.WORD)
    for i, t in enumerate(LICENSES):
        words = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(j, label) for p, label in op5.PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((j for j, _ in places), default=None) and r["last_word"] == max((j for j, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
    labels = [set(filter(None, got[i]["labels"].split(","))) for i in range(len(LICENSES))]
    assert labels[0] == {"mit", "mit-notice"} and labels[4] == {"apache-2", "apache-2.0-notice"}
    assert labels[6] == labels[7] == {"gpl-3.0-notice"} and labels[8] == set()


def test_template_automata():
    m = op5.compile_template("a <<beginOptional>>b <<var;max=2>> c<<endOptional>> d")
    spans = lambda text: m.spans(text.split())
    assert spans("x a d y") == [(1, 3)] and spans("a b c d") == [(0, 4)] and spans("a b x y c d a d") == [(0, 6), (6, 8)]
    assert spans("a b x y z c d") == [] and spans("a b d") == [] and spans("a a d") == [(1, 3)]
    for bad in ("a <<endOptional>>", "<<beginOptional>>a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            op5.compile_template(bad)


def page(blocks, nav="Home About", tail="", body_end="</body></html>"):
    inner = "".join(f"<p>{b}</p>" for b in blocks)
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>{nav}</a></li></ul></nav>"
        f"<!-- note --><div class='ad'>Buy</div><div class='wrap'><div class='sidebar'>Side {nav}</div><div class='post'>{inner}</div>"
        f"<div id='comments'><p>Reader says {tail}</p></div><form>Search</form></div><footer>&copy; {tail}</footer>{body_end}"
    )


def test_wrappers_find_the_content(spark):
    bodies = [[f"Title {i} &amp; more", f"Text  {i}\n with <b>bold</b> words", *["Another one."] * (i % 3)] for i in range(9)]
    rows = [(i, f"https://h{i % 2}.example.com/{i}", page(b, tail=str(i), body_end="" if i % 4 else "</body></html>"), "x") for i, b in enumerate(bodies)]
    rows += [(20, "https://h0.example.com/e", "", "x"), (21, "https://h0.example.com/n", None, "x"), (22, "no host", page(["Alone"]), "x"), (None, None, None, "x")]
    got = {r["page_id"]: r for r in op8.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i, b in enumerate(bodies):
        want = "\n".join(" ".join(re.sub("<[^>]*>", "", x).replace("&amp;", "&").split()) for x in b)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert got[20]["text"] == got[21]["text"] == got[None]["text"] == "" and got[22]["text"] == "Alone"
    assert op8.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_expression():
    found = op8.infer(["<body><article><h1>A</h1><p>x</p></article></body>", "<body><article><p>y</p><p>z</p></article></body>"])
    assert found.root.show() == "<><article>(<h1>#)?(<p>#)+" and len(found.pages) == 2
    again = op8.Wrapper.load(found.dump())
    assert again.dump() == found.dump() and again.kept() == {0, 1}


def test_text_that_all_pages_share_goes():
    """No class or tag tells what is boilerplate; that the pages agree does."""
    frame = "<div class='x1'><p>We have moved to a new address</p></div><div class='x2'>{}</div><div class='x3'>Call us: 12345</div>"
    pages = [frame.format(f"<h2>Title {i}</h2><p>Body {i} one</p>" + f"<p>Body {i} two</p>" * (i % 3)) for i in range(8)]
    wrapper = op8.infer(pages)
    for i, p in enumerate(pages):
        want = [f"Title {i}", f"Body {i} one"] + [f"Body {i} two"] * (i % 3)
        assert op8.main_text(p, wrapper) == ("\n".join(want), True)
        assert op8.main_text(p, None)[0].count("\n") == len(want) + 1
    few = op8.infer(pages[:2])
    assert op8.main_text(pages[0], few)[0].startswith("We have moved")
    copies = op8.infer(pages[:1] * 20)
    assert op8.main_text(pages[0], copies)[0].endswith("Call us: 12345")


def test_equal_articles_stay():
    """Mirrors and print views: the article is the same on all pages, their frame is not."""
    article = "The article that all pages share has many words. " * 6
    for around in ("<div class=content>{}</div>", "<article>{}</article>", "<main><section>{}</section></main>"):
        pages = [f"<body><p class=top>Top {i} visits</p>" + around.format(f"<p>{article}</p>") + f"<p class=rand>rand {i}</p></body>" for i in range(8)]
        wrapper = op8.infer(pages)
        for i, p in enumerate(pages):
            text, fits = op8.main_text(p, wrapper)
            assert fits and article.strip() in text.split("\n"), text


def test_names_of_paragraphs_in_the_article():
    page = "<body><article><p>One.</p><p class='price-alert'>Prices fell.</p><p class='market-share'>A third.</p><div class='share-buttons'>Tweet</div><div class='related'>More</div></article></body>"
    assert op8.main_text(page, None)[0] == "One.\nPrices fell.\nA third."


def test_page_that_does_not_fit_is_read_by_itself():
    wrapper = op8.infer(["<div><p>a</p></div>", "<div><p>b</p></div>"])
    assert op8.main_text("<section><h3>c</h3><p>d</p></section>", wrapper) == ("c\nd", False)


def test_nothing_of_the_article_is_left_behind():
    texts = lambda html: op8.main_text(html, None)[0]
    assert texts("<body><h1>title</h1><div>body</div></body>") == "title\nbody"
    assert texts("<article class=teaser>short</article><div><p>" + "long text " * 20 + "</p></div>").startswith("short\nlong text")
    assert texts("<article class=a><p>one</p></article><article class=b><p>two</p></article>") == "one\ntwo"
    assert texts("<body class='right-sidebar'><div id='content-with-sidebar'>x</div><p class='notice-board'>y</p>") == "x\ny"
    assert texts("<body><header>Site head</header><div><p>one</p><p>two</p></div>") == "one\ntwo"
    assert texts("<article><header><h1>Head</h1></header><p>x</p><footer>f</footer></article>") == "Head\nx"
    assert texts("<div class='comment-list'><p>no</p></div><div id='cookie-notice'>no</div><p class='notice'>no</p><p>yes</p>") == "yes"
    assert texts("<ul>" + "<li><a href='/x'>go</a></li>" * 5 + "</ul><p>yes <a>linked</a></p>") == "yes linked"


def test_malformed_html():
    tree = "<article><h1>One</h1><p><b>Two<br><p>Three &lt;x&gt; 1 < 2</p><p>Four</article><footer>no</footer>"
    text = lambda html: op8.main_text(html, None)[0]
    assert text(tree) == "One\nTwo\nThree <x> 1 < 2\nFour"
    assert text("<script>never closed <p>x</p>") == "" and text("plain") == "plain" and text('<p title="a"b">text</p>') == "text"


def test_deep_long_and_broken_pages_take_linear_time():
    start = time.monotonic()
    assert op8.main_text("<div>" * 5000 + "deep" + "</div>" * 5000, None)[0] == "deep"
    assert "x" in op8.main_text('<a b="' * 100_000 + ">x<p>y", None)[0]
    long = "<p>one" * 60_000 + "<h2>x<p>y" * 20_000
    wrapper = op8.infer([long, "<p>short</p>"])
    assert op8.main_text(long, wrapper) == ("\n".join(["one"] * 60_000 + ["x", "y"] * 20_000), True)
    kinds = "".join(f"<div class=c{i}a>{i}</div><x{i}>k{i}</x{i}>" for i in range(3000))
    assert op8.main_text(kinds, op8.infer([kinds, "<div>z</div>"]))[0].count("\n") == 5999
    assert time.monotonic() - start < 40


def test_wrappers_of_many_parts_meet(spark):
    """Wrappers from many tasks are aligned in groups, and drop what all pages share."""
    rows = [(i, "https://hot.example.org/" + str(i), f"<div class=u{i % 7}><p>Same words</p></div><section><p>Body {i}</p></section>") for i in range(140)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(70)
    got = {r["page_id"]: r["text"] for r in op8.extract(pages).collect()}
    assert got == {i: f"Body {i}" for i, _, _ in rows}


def test_avi_round_trip():
    rng = np.random.default_rng(1)
    payloads = [b"\0" * 64, b"\xff" * 128, bytes(rng.integers(0, 256, 64 * 200, np.uint8)), b"text " * 64, bytes(range(256))]
    files = mjpeg.write_avis(payloads)
    for p, (parsed, frames) in zip(payloads, mjpeg.read_avis(files), strict=True):
        assert frames.tobytes()[: parsed["samples"]] == p and parsed["samples"] == len(p)
    for bad in (b"", b"RIFF\0\0\0\0WAVE", files[0][:200]):
        with pytest.raises(ValueError):
            mjpeg.parse_avi(bad)


def plain_decode(frame):
    """One lossless frame, bit by bit."""
    at, table, size = 2, None, None
    while frame[at + 1] != 0xDA:
        length = int.from_bytes(frame[at + 2 : at + 4])
        body = frame[at + 4 : at + 2 + length]
        if frame[at + 1] == 0xC4:
            codes, code, k = {}, 0, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    codes[(n, code)] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            table = codes
        if frame[at + 1] == 0xC3:
            size = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
        at += 2 + length
    at += 2 + int.from_bytes(frame[at + 2 : at + 4])
    parts = re.split(rb"\xff[\xd0-\xd9]", frame[at:], flags=re.S)[: size[0]]
    rows = []
    for part in parts:
        bits, place, value, row = "".join(f"{b:08b}" for b in part.replace(b"\xff\0", b"\xff")), 0, 128, []
        while len(row) < size[1]:
            n = next(n for n in range(1, 17) if (n, int(bits[place : place + n], 2)) in table)
            category = table[(n, int(bits[place : place + n], 2))]
            extra = bits[place + n : place + n + category]
            value += 0 if not category else int(extra, 2) - (0 if extra[0] == "1" else (1 << category) - 1)
            place += n + category
            row.append(value & 255)
        rows.append(row)
    return rows


def test_frames_decode_as_a_plain_decoder_does():
    rng = np.random.default_rng(4)
    payload = bytes(rng.integers(0, 256, 64 * 70, np.uint8)) + b"\xff\0" * 32 * 9
    file = mjpeg.write_avis([payload])[0]
    parsed, frames = mjpeg.read_avis([file])[0]
    plain = [plain_decode(file[at : at + n]) for at, n in parsed["frames"]]
    assert np.array_equal(np.array(plain).reshape(frames.shape), frames)


def test_other_files_are_refused_and_tables_are_read():
    file = mjpeg.write_avis([bytes(np.random.default_rng(2).integers(0, 256, 512, np.uint8))])[0]
    for old, new in ((b"\xff\xc3", b"\xff\xc0"), (b"\xff\xdd\x00\x04\x00\x40", b"\xff\xdd\x00\x04\x00\x20"), (b"\x00\x01\x00\x00\xff", b"\x00\x04\x00\x00\xff")):
        if file.replace(old, new) != file:
            with pytest.raises(ValueError):
                mjpeg.read_avis([file.replace(old, new)])
    # another table: the categories of the two shortest codes change places, and so do decoded values
    at = file.index(b"\xff\xc4") + 4 + 17
    turned = file[:at] + file[at + 1 : at + 2] + file[at : at + 1] + file[at + 2 :]
    try:
        assert not np.array_equal(mjpeg.read_avis([turned])[0][1], mjpeg.read_avis([file])[0][1])
    except ValueError:
        pass


def test_long_texts_are_coded_in_portions():
    payload = bytes(np.random.default_rng(1).integers(97, 123, 64 * 40_000, np.uint8))
    parsed, frames = mjpeg.read_avis(mjpeg.write_avis([b"x" * 64, payload, b"y" * 128]))[1]
    assert frames.tobytes()[: parsed["samples"]] == payload


def test_shots_as_a_plain_loop_finds_them():
    rng = np.random.default_rng(6)
    levels = rng.integers(0, 220, 12)
    frames = np.concatenate([np.clip(rng.normal(x, 8, (int(n), 256)), 0, 255) for x, n in zip(levels, rng.integers(2, 9, 12), strict=True)]).astype(np.uint8)
    shares = [[sum(1 for v in f if v // 16 == b) / 256 for b in range(16)] for f in frames.tolist()]
    gaps = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 2 for x, y in zip(shares, shares[1:], strict=False)]
    starts = [0]
    for i, d in enumerate(gaps):
        recent = gaps[max(starts[-1], i - op9.REMEMBERED) : i]
        mean = sum(recent) / len(recent) if recent else 0
        limit = mean + op9.DEVIATIONS * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0
        starts += [i + 1] if d > max(limit, op9.LEAST_DIFFERENCE) else []
    assert op9.shot_starts(op9.histograms(frames)) == starts and len(starts) > 5


@pytest.mark.parametrize("scan", [lambda d: op5.scan_licenses(d), lambda d: op9.described(op9.to_media(d))])
def test_scans_on_odd_tables(spark, scan):
    rows = [(2**60 + 1, "under the mit license " * 20_000, "x"), (None, None, "y"), (None, None, "y"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = scan(docs).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 3, 2**60 + 1] and scan(docs.limit(0)).count() == 0


def test_license_texts():
    scanner = op5.Scanner(op5.PHRASES, op5.TEMPLATES)
    labels = lambda text: set(filter(None, scanner.scan(text)[5].split(",")))
    plain = lambda t: re.sub(r"<<begin.*?<<endOptional>>|<<var.*?>>", " ", re.sub(r"<<beginOptional>>[^<]*<<endOptional>>", " ", t))
    for label, template in op5.TEMPLATES.items():
        words = plain(plain(template)).split()
        text = "Before. " + " ".join(words).title() + ". After."
        assert label in labels(text), label
        middle = len(words) // 2
        assert label not in labels(" ".join([*words[:middle], "other", *words[middle:]])) or "<<var" in template
    assert labels("x") == set()
    assert op5.Scanner(op5.PHRASES, {}).scan("é cc by nc, CC-BY-NC " * 3)[:4] == (21, 6, 1, 18)


def test_media_columns(spark):
    texts = ["", None, "a", "é" * 40, "x" * 64, "word " * 5000, "a"]
    media = op9.to_media(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in op9.described(media).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert got[2]["media_sha256"] == got[6]["media_sha256"] and got[0]["feature"] == got[1]["feature"]


def test_shots_become_clips(spark):
    dark, bright = bytes([20] * 4096), bytes([200] * 4096)
    media = spark.createDataFrame([(1, bytearray(mjpeg.write_avis([dark * 3 + bright * 2])[0])), (2, None)], "doc_id long, media binary")
    found = [(r["clip"], r["first_frame"], r["n_frames"], r["start_s"], r["end_s"]) for r in op9.clips(media).orderBy("clip").collect()]
    assert found == [(0, 0, 3, 0.0, 0.12), (1, 3, 2, 0.12, 0.2)]
