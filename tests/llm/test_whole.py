"""Inputs beyond the test tables: large hosts, long paths, wrapped notices, large pools."""

from pyspark.sql import functions as F

from curastra.llm.url_filter import filter_urls, parse_rules


def test_sections_of_a_large_host_are_judged_apart(spark):
    folders = ["en"] + [f"{a}{b}" for a in "abc" for b in "fghijklmno"][:29]
    urls = [f"http://big.com/en/{k}" for k in range(40)] + [f"http://big.com/{folders[1 + k % 29]}/{1000 + k}" for k in range(960)]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), parse_rules("block", ["com/en/"])).collect()
    assert {(r.path.startswith("/en/"), r.verdict) for r in got} == {(True, "block"), (False, "allow")}
    assert len(got) == 1000


def test_levels_past_the_sixth_are_generalised(spark):
    deep = "http://h.x/a/b/c/d/e/f/g"
    urls = [f"{deep}/ads/{k}" for k in range(40)] + [f"{deep}/news/{k}" for k in range(40)] + [f"{deep}/rare/{k}/x/y{k}.html" for k in range(3)] + ["http://h.x/"]
    rules = parse_rules("block", [f"h.x/a/b/c/d/e/f/g/ads/{k}" for k in (1, 2, 3)])
    got = {r.path: (r.verdict, r.template) for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).where("rule is null").collect()}
    assert {v for p, (v, _) in got.items() if "/ads/" in p} == {"block"} and {v for p, (v, _) in got.items() if "/ads/" not in p} == {"allow"}
    top = next(t for p, (_, t) in got.items() if "/rare/" in p)
    assert top.endswith("/<*>/<n>/<*>/<*>.html") and got["/"][1] == ""


def test_every_unlabelled_document_can_get_a_pseudo_label(spark, monkeypatch):
    from curastra.llm import quality
    from tests.llm.test_text import _labelled

    rows, labels = _labelled(900, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels[:200], "doc_id long, quality int")
    passes, whole = [], quality._margins
    monkeypatch.setattr(quality, "_margins", lambda rows, *a: passes.append(rows.count()) or whole(rows, *a))
    added, learn = [], quality.TextView.learn
    monkeypatch.setattr(quality.TextView, "learn", staticmethod(lambda bags, *a: added.append(len(bags)) or learn(bags, *a)))
    settings = quality.Settings(labelled=200, pool=60, rounds=2, per_round=20)
    model = quality.train(docs, known, settings)
    assert passes == [900, 900]  # each round sees all documents, however few the driver holds
    assert added[-1] > added[0] and model is not None
    truth = dict(labels)
    verdict = {r.doc_id: r.accepted for r in quality.classify(docs, model).collect()}
    assert sum(verdict[i] == bool(y) for i, y in truth.items()) / len(truth) > 0.95


def test_wrapped_notices_are_found(spark):
    from curastra.llm.license_scan import scan_licenses

    texts = [
        "x\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\ny",
        "Redistribution and use in source and binary\nforms, with or without modification, are permitted provided\nthat the following conditions are met:",
        "Copyright all\nrights here. Reserved",  # no four consecutive words
        "licensed under the\n\napache license\nversion 2.0",
    ]
    got = [(r.labels, r.score) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [("mit-grant", 1.0), ("bsd-conditions", 1.0), ("", 0.0), ("apache-2,apache-2-notice", 1.0)]
