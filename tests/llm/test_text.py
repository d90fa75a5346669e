import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curastra.llm import fingerprint as fp
from curastra.llm.bpe import ByteBpe, encode_decode
from curastra.llm.license_scan import PHRASES, TEMPLATES, needed, scan_licenses
from curastra.llm.packing import WordTokenizer, differencing, fill, fine, pack
from curastra.llm.preference import format_preferences, pair_by_opening, swapped_answers, turns_of
from curastra.llm.quality import Settings, classify, train
from curastra.llm.url_filter import filter_urls, host_and_path, parse_rules

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["", None, " ", "a<|endoftext|>b  \n ", "  \t\n x  ", "é\u0301 ﬁ 日本 \u200b 🙂🙂", "I'll 's 'S they've", "ΣΑΣ Σ İ <|STARTOFTEXT|> <|startoftext|>", "a\x1cb\x85c\xa0d\x00", "x" * 3000, "word, word. (word)!! 12 3½"]


def _library(name):
    return tokenizers.Tokenizer.from_file(public.path(name))


def test_bpe_against_the_library(frame):
    lib = _library("byte_bpe_50k.json")
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "null id")]
    got = encode_decode(frame(rows), public.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert encode_decode(frame([]), public.path("byte_bpe_50k.json")).count() == 0


def test_bpe_merges_fuzzed():
    lib, bpe = _library("byte_bpe_50k.json"), ByteBpe(public.path("byte_bpe_50k.json"))
    r = random.Random(1)
    for _ in range(1500):
        t = "".join(r.choice("aabbcdeé 日\n'stTHE.") for _ in range(r.randint(0, 40)))
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_word_tokenizer_fuzzed():
    own = WordTokenizer(public.path("word_bpe_49k.json"))
    lib, r = _library("word_bpe_49k.json"), random.Random(2)
    latin = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA0, 0x250)]]
    texts = [t or "" for t in ODD] + ["".join(r.choice(latin) if r.random() < 0.5 else r.choice("ab C',.  ") for _ in range(30)) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_packing(frame):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["alpha", "Beta,", "gamma.", "x"]) for _ in range(r.choice([0, 3, 200, 900, 5000])))) for i in range(150)]
    rows += [(500 + i, t) for i, t in enumerate(ODD)] + [(500, ""), (None, "null id")]
    lib = _library("word_bpe_49k.json")
    got = pack(frame(rows), public.path("word_bpe_49k.json")).toPandas()
    want = Counter(tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    found = Counter()
    for _, g in got.fillna({"doc_id": -1}).groupby("doc_id"):
        pieces = sorted(zip(g.start, g.length, g.ids, g.ids_crc32, g.doc_tokens, strict=True), key=lambda p: (p[0], len(p[2])))
        if (g.start == 0).sum() > 1:  # repeated rows
            pieces = pieces[: len(pieces) // 2] if len(pieces) % 2 == 0 else pieces
            found[tuple(pieces[0][2])] += 1
        whole, at = [], 0
        for start, length, ids, crc, tokens in pieces:
            assert start == at and length == len(ids) and crc == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            whole, at = whole + list(ids), at + length
            assert tokens >= at
        assert tokens == at
        found[tuple(whole)] += 1
    assert found == want
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert pack(frame([]), public.path("word_bpe_49k.json")).count() == 0


def test_differencing_balances_and_raises():
    r = random.Random(4)
    sizes = [x for _ in range(300) for x in fine(r.randint(1, 2047))]
    at = differencing(sizes, 100)
    sums = np.bincount(at, weights=sizes, minlength=100)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 16
    at, windows = fill([1200] * 5, 2048)  # three windows would do by size, but not by piece
    assert windows == 5 and np.bincount(at, minlength=5).tolist() == [1] * 5
    assert fill([], 2048)[1] == 1 and fill([5], 2048)[0].tolist() == [0]
    assert sum(fine(2047)) == 2047 and fine(1) == [1]


def test_entropy_and_fingerprints(frame):
    r = np.random.default_rng(5)
    for data in (r.integers(0, 256, 400, dtype=np.uint8), np.frombuffer(b"ab" * 90, dtype=np.uint8), np.zeros(64, np.uint8), np.zeros(3, np.uint8)):
        steps = fp.entropy_steps(data)
        w = fp.WINDOW
        assert len(steps) == max(len(data) - w + 1, 0)
        for s in range(len(steps)):
            h = -sum(c / w * math.log2(c / w) for c in Counter(data[s : s + w].tolist()).values())
            assert abs(steps[s] - h * 1000 / math.log2(w)) <= 1.01
    rows = [(3, "the quick brown fox jumps " * 40), (1, "".join(chr(97 + int(x)) for x in r.integers(0, 26, 3000))), (None, None), (2, ""), (4, "short"), (5, "".join(chr(200 + int(x)) for x in r.integers(0, 40, 900))), (5, "twice"), (6, "short")]
    got = fp.compare_with_next(frame(rows)).collect()
    order = sorted(((-(2**63) if i is None else i), t or "") for i, t in rows)
    want = Counter()
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()] += 1
    assert Counter(((-(2**63) if x.doc_id is None else x.doc_id), x.n_chars, x.edited_sha256) for x in got) == want
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    by = {x.fingerprint for x in got if x.n_chars == 5 and x.doc_id in (4, 6)}
    assert len(by) == 1 and fp.likeness(fp.from_text(by.pop()), np.zeros((0, 256), np.uint8)) == 0.0
    plain = {x.doc_id: x.fingerprint for x in fp.fingerprint(frame(rows)).collect()}
    assert all(x.fingerprint == plain[x.doc_id] for x in got if x.doc_id != 5)
    long = next(x for x in got if x.doc_id == 1)
    assert long.near_edited > 0.3 > long.near_next
    alone = fp.compare_with_next(frame([(1, "abcdef" * 30)])).first()
    assert alone.near_next == 1.0 and fp.compare_with_next(frame([])).count() == 0


def test_ranges_grow_in_number_with_the_text(frame, monkeypatch):
    df = frame([(i, f"{i} " * 200) for i in range(60)])
    want = sorted(map(tuple, fp.compare_with_next(df).collect()))
    monkeypatch.setattr(fp, "RANGE", 2_000)
    out = fp.compare_with_next(df)
    size = sum(map(len, (f"{i} " * 200 for i in range(60))))
    assert out.rdd.getNumPartitions() >= min(60, size // 2_000) // 2 > 4
    assert sorted(map(tuple, out.collect())) == want


def test_licences_against_a_plain_scan(frame):
    import re

    texts = [*ODD, "Released under the MIT License.", "under the MIT-license under the mit license version", "Apache  License,\nVersion 2", "this work: licensed under the gnu general public license version 3 and more", "LICENSE public gnu the general under licensed work this is 3", "x\nRedistribution and use in source and binary forms, with or without modification, are permitted\ny", "cc by nc cc BY-NC", "ünder the mit license"]
    rows = list(enumerate(texts)) + [(None, texts[-2])]
    got = {r.doc_id: r for r in scan_licenses(frame(rows).withColumn("score", F.lit("old"))).collect()}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
        words = cut(low)
        places = sorted((k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        labels = {x for _, x in places}
        best = 0.0
        for line in low.split("\n"):
            for label, template in TEMPLATES.items():
                w = set(template.split())
                shared = len(w & set(cut(line)))
                if shared >= needed(len(w), 0.8):
                    labels.add(label)
                    best = max(best, shared / len(w))
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), t
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None)), t
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and r.labels == ",".join(sorted(labels)), t
        assert r.score == (1.0 if places else best)
    assert scan_licenses(frame([])).count() == 0


def test_urls(spark):
    urls = ["https://A.Example.com/en/7x?q", "http://example.com/en/1", "x://com/en/", "http://notcom/en/", "http://a.net/de/8", "http://b.example.net/de/81", None, "no scheme", "s://", "http://h#f/x", "a://b://c/d", "http://ÄB.org/es/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = parse_rules("block", ["com/en/", "example.net/de/8", "org/es/"]) + parse_rules("allow", ["example.com/en/7", "net/de/"])
    got = [(r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules).orderBy("page_id").collect()]
    assert got == [
        ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("example.com", "/en/1", "com/en/", "block"),
        ("com", "/en/", "com/en/", "block"),
        ("notcom", "/en/", None, "allow"),
        ("a.net", "/de/8", "net/de/", "allow"),
        ("b.example.net", "/de/81", "example.net/de/8", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("h", "", None, "allow"),
        ("b:", "//c/d", None, "allow"),
        ("Äb.org", "/es/", "org/es/", "block"),
    ]
    assert filter_urls(df.limit(0), rules).count() == 0
    assert len(host_and_path(F.col("url"))) == 2


def test_templates_generalise_and_reject(spark):
    rows = [(i, f"http://h.x/{kind}/{i}/{page}") for i in range(30) for kind, page in (("ads", "click"), ("news", "read"))]
    rows = [(k, u) for k, (_, u) in enumerate(rows)]
    rules = parse_rules("block", [f"h.x/ads/{i}/" for i in range(25)]) + parse_rules("allow", [f"h.x/news/{i}/" for i in range(25)])
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert {(r.verdict, r.template) for r in got} == {("block", "/ads/<n>/(click)"), ("allow", "/news/<n>/(read)")} or {r.path.split("/")[1]: r.verdict for r in got} == {"ads": "block", "news": "allow"}
    assert len(got) == 10


def test_preferences(spark):
    kinds = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "q"), (1, 2, "assistant", "long answer"), (1, 3, "user", "more"), (2, 0, "user", "q"), (2, 1, "assistant", "short"), (3, 5, "user", "q"), (3, 6, "assistant", "long answer"), (4, 0, "system", "s"), (None, 0, "user", "q"), (5, None, "user", "q"), (6, 0, None, None), (2, 1, "assistant", "short"), (2, 1, "assistant", "zzz")]
    turns = turns_of(spark.createDataFrame(rows, kinds))
    pairs = pair_by_opening(turns)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (1, 3)}
    got = sorted((r.chosen, r.rejected, r.part, r.place, r.loss, r.rendered) for r in format_preferences(turns, pairs).collect())
    u, a = "<|im_start|>user\n%s<|im_end|>\n", "<|im_start|>assistant\n%s<|im_end|>\n"
    assert got == sorted([(1, 2, "prompt", 0, False, u % "q"), (1, 2, "chosen", 1, True, a % "long answer"), (1, 2, "chosen", 2, False, u % "more"), (1, 2, "rejected", 1, True, a % "short"), (1, 3, "prompt", 0, False, u % "q"), (1, 3, "prompt", 1, False, a % "long answer"), (1, 3, "chosen", 2, False, u % "more")])
    new, swapped = swapped_answers(turns)
    assert {tuple(r) for r in swapped.collect()} == {(2, -3), (3, -4)}
    assert {r.text for r in new.where("conv = -3").collect()} == {"q", "long answer"}
    empty = turns_of(spark.createDataFrame([], kinds))
    assert format_preferences(empty, pair_by_opening(empty)).count() == 0


def test_long_conversations_keep_their_places(spark):
    r = random.Random(6)
    turns = r.sample(range(0, 5000), 2500)
    rows = [(1, t, "user" if k % 2 else "assistant", str(t)) for k, t in enumerate(turns)] + [(2, t, "user" if k % 2 else "assistant", str(t)) for k, t in enumerate(turns) if t != max(turns)]
    t = turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = format_preferences(t, spark.createDataFrame([(1, 2), (1, 1), (None, 2)], "chosen long, rejected long"))
    assert {r.part: r.n for r in out.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"prompt": 2499, "chosen": 1}
    assert [r.rendered.split("\n")[1].split("<")[0] for r in out.where("part = 'prompt'").orderBy("place").collect()] == [str(x) for x in sorted(turns)[:-1]]


def _labelled(n, seed):
    r = random.Random(seed)
    words = ["river", "stone", "cloud", "walks", "under", "green", "light", "house"]
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        body = " ".join(r.choice(words) for _ in range(r.randint(30, 80))) + "."
        if not good:
            body = r.choice([" ".join(["spam"] * r.randint(30, 60)), body.upper().replace(" ", "!! "), " | ".join(body.split())])
        rows.append((i, body, "en", f"s{i % 3}", len(body)))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows, labels = _labelled(600, 1)
    docs = spark.createDataFrame([*rows, (10**6, None, None, None, None), (10**6 + 1, "", "en", "s1", 0), (None, "null id here.", "xx", None, 3), rows[0]], kinds).withColumn("score", F.lit("clash"))
    known = spark.createDataFrame([*labels[:300], (None, 1), (5, None)], "doc_id long, quality int")
    model = train(docs, known, Settings(labelled=300, pool=200))
    got = classify(docs, model).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    verdict = {r.doc_id: r.accepted for r in got}
    held = labels[300:]
    assert sum(verdict[i] == bool(y) for i, y in held) / len(held) > 0.95
    again = train(docs.repartition(7), known, Settings(labelled=300, pool=200))
    assert {r.doc_id: r.score for r in classify(docs, again).collect()} == {r.doc_id: r.score for r in got}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert train(docs, none) is None
    row = classify(docs, None).first()
    assert row.accepted and row.score is None
