"""Each operator on small tables: nulls, empty and long texts, repeated rows, empty tables, and columns with clashing names."""

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keystrata.llm import decontamination, jaccard_join, language_id, license_scan, line_dedup, quality_resampling, secret_scan, source_mixing, substring_dedup, topk_search
from keystrata.llm.textbytes import NOT_SPACE, Texts, Words, windows

#: Names that operators use, or used, themselves, with values that tell whether a column is carried over.
CLASHES = ["_mark", "_gone", "_source", "copy", "size", "target", "copies", "source_size", "_hit", "_n_words", "_items", "n_words", "hit", "items", "key", "log_weight", "n_lines", "n_dropped", "mark", "sig", "component", "n", "is_doc", "held", "block", "g", "h"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"


def docs(spark, texts, sources=None):
    rows = [(i if i is None or isinstance(i, int) else i, t, None, s, None, "x", "y") for i, t, s in ((i, t, s) for (i, t), s in zip(texts, sources or ["a"] * len(texts), strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(df, key=0):
    return {r[key]: tuple(r) for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, LONG), (None, "no id at all"), (5, "é x y"), (5, "é x y")]


@pytest.mark.parametrize("run", [
    source_mixing.digest, line_dedup.digest, license_scan.scan_licenses, substring_dedup.digest, secret_scan.digest, jaccard_join.similar_components,
])
def test_odd_and_empty_tables(spark, run):
    assert run(docs(spark, ODD)).count() == len(ODD)
    assert run(docs(spark, ODD).limit(0)).count() == 0


def test_words_and_windows_equal_a_plain_loop():
    texts = ["a  b\tc a b c", "", "a b c", "\n\n", "ü a b c"]
    words = Words(Texts(pa.array(texts)), NOT_SPACE)
    assert [words.bytes_of(k).decode() for k in range(len(words))] == [w for t in texts for w in t.split()]
    h, start, text = windows(words.hashes(), words.first, 3)
    plain = [(i, tuple(t.split()[k : k + 3])) for i, t in enumerate(texts) for k in range(len(t.split()) - 2)]
    assert text.tolist() == [i for i, _ in plain]
    same = np.equal.outer(h, h)
    assert (same == np.array([[a == b for _, b in plain] for _, a in plain])).all()


def test_mixing(spark):
    rows = [(i, "w " * (i % 7 + 1)) for i in range(400)]
    sources = [None if i % 20 == 0 else "a" if i % 2 else "b" for i in range(400)]
    got = table(source_mixing.digest(docs(spark, rows, sources)))
    assert got == table(source_mixing.digest(docs(spark, rows, sources)))
    by = {}
    for (_, _, source_size, target, taken), s in zip((got[i] for i in range(400)), sources, strict=True):
        by.setdefault(s, [source_size, target, 0])[2] += taken
    total = sum(len(t.split()) for _, t in rows)
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6
    assert by[None][1] == 3 * by[None][0] == by[None][2]  # capped, so exactly three copies of each
    assert all(abs(taken - target) < 0.15 * target for _, target, taken in by.values())
    assert source_mixing.mix(docs(spark, rows, sources)).groupBy("doc_id").count().agg(F.max("count")).first()[0] == 3


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  Common Line \n\ncommon line\nlast") for i in range(12)] + [(20, "nothing common"), (21, None), (22, "common line")]
    got = table(line_dedup.digest(docs(spark, rows)))
    assert got[3] == (3, 5, 3, sha("own 3\n")) and got[20][2] == 0 and got[21] == (21, 1, 0, sha("")) and got[22] == (22, 1, 1, sha(""))
    first = table(line_dedup.drop_common_lines(docs(spark, rows), keep_first=True).select("doc_id", "text"))
    assert first[0][1] == "own 0\n  Common Line \n\nlast" and first[1][1] == "own 1\n"
    tiny = line_dedup.drop_common_lines(docs(spark, rows), bits=512, hashes=2)  # nearly all keys are suspects: same result
    assert {r["doc_id"]: r["n_dropped"] for r in tiny.collect()} == {k: v[2] for k, v in got.items()}
    joined = line_dedup.drop_common_lines(docs(spark, rows), broadcast_bytes=-1).collect()  # the other way, without a broadcast
    assert {r["doc_id"]: r["n_dropped"] for r in joined} == {k: v[2] for k, v in got.items()}
    joined = line_dedup.drop_common_lines(docs(spark, rows), keep_first=True, broadcast_bytes=-1)
    assert table(joined.select("doc_id", "text")) == first


def test_line_dedup_takes_each_row_for_a_document(spark):
    rows = [(1, "a\nb")] * 10 + [(2, "a\nc")]
    for broadcast_bytes in (-1, 1 << 20):
        got = line_dedup.drop_common_lines(docs(spark, rows), broadcast_bytes=broadcast_bytes).collect()
        assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(1, 2)] * 10 + [(2, 1)]


def test_licenses(spark):
    text = "x Licensed under the Apache License, Version 2.0. cc-by! Copyright (c) 2020 Some One. All rights reserved; GENERAL public License"
    got = license_scan.scan_licenses(docs(spark, [(1, text), (2, "all rights are reserved"), (3, "under the MIT licence")])).collect()
    one = got[0]
    assert (one["n_base"], one["base_labels"], one["labels"]) == (3, "cc-by,gpl,reserved", "apache-2.0,cc-by,copyright,gpl,reserved")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    assert (one["first_word"], one["last_word"]) == (words.index("cc"), words.index("general")) and 0 < one["score"] <= 1
    assert [(r["n_base"], r["first_word"], r["labels"], r["score"]) for r in got[1:]] == [(0, None, "", 0.0)] * 2
    a = license_scan.Automaton("a b <<opt>>c <<opt>>d<</opt>><</opt>> <<var 2>> e")
    accepts = lambda s: a.match(lambda k: s.split()[k].encode(), 0, len(s.split())) == len(s.split())
    assert all(map(accepts, ("a b e", "a b c e", "a b c d e", "a b x y e"))) and not any(map(accepts, ("a b", "a b d c x e", "a c e")))


@pytest.mark.parametrize("text", ["Copyright 2020 X. All rights reserved", "x Copyright © 2020 X, Y and Z. All rights reserved", "copyright (c) X all rights reserved", "Copyright all rights reserved"])
def test_licenses_open_where_any_word_may_be_the_second(spark, text):
    got = license_scan.scan_licenses(docs(spark, [(1, text)])).first()
    n = got["n_words"]
    assert got["labels"] == "copyright,reserved" and [tuple(s) for s in got["spans"]][0] == ("copyright", int(text.startswith("x ")), n)
    assert license_scan.Automaton("a <<opt>>b<</opt>>").openings() == {(b"a",)} and license_scan.Automaton("a <<opt>>b<</opt>> c").openings() == {(b"a", b"b"), (b"a", b"c")}


GPL = "under the terms of the GNU General Public License as published by the Free Software Foundation"
NOTICES = [  # notice, label, and what its span covers
    (f"you can redistribute it and/or modify it {GPL}; either version 2 of the License, or (at your option) any later version.", "gpl-2.0", 29),
    (f"you can redistribute it and/or modify it {GPL}, either version 3 of the License, or (at your option) any later version.", "gpl-3.0", 29),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa", 8),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc", 8),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa", 9),
    ("This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd", 8),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", "cc-by-nc-nd", 9),
    ("Text is available under the Creative Commons Attribution-Share Alike 3.0 Unported", "cc-by-sa", 8),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by", 7),
]


def test_standard_license_notices(spark):
    got = license_scan.scan_licenses(docs(spark, [(i, t) for i, (t, _, _) in enumerate(NOTICES)])).orderBy("doc_id").collect()
    assert [[(s["label"], s["to"] - s["from"]) for s in r["spans"] if s["label"] != "gpl"] for r in got] == [[(label, n)] for _, label, n in NOTICES]


def removal(rows, size):
    least, out = {}, {}
    for i, t in sorted((i, t or "") for i, t in rows):
        w = t.split()
        for k in range(len(w) - size + 1):
            least.setdefault(tuple(w[k : k + size]), i)
    for i, t in rows:
        w = (t or "").split()
        gone = {j for k in range(len(w) - size + 1) if least[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out[i] = (i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{k}x{j}" for j in range(20)) for k in range(4)]
    rows = [(int(i), " ".join([" ".join(f"u{x}" for x in rng.integers(0, 5000, 15)), passages[i % 4], "z " * (i % 30)])) for i in rng.permutation(60)] + [(99, None), (98, "short")]
    assert table(substring_dedup.digest(docs(spark, rows))) == removal(rows, 13)
    few = substring_dedup.remove_repeats(docs(spark, rows), 4, n_ranges=3).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    assert table(few) == removal(rows, 4)


def test_decontamination(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (10, "ETA theta iota kappa lambda mu nu xi"), (3, None), (None, "x y"), (4, "solo")], "item_id long, text string")
    rows = [(1, f"xx {item.upper()}, lambda mu nu xi"), (2, "a TINY-item here"), (3, None), (4, "alpha beta gamma delta epsilon zeta eta"), (5, "a solo act, solo")]
    got = table(decontamination.digest(docs(spark, rows), bench))
    assert got[1] == (1, 15, 14, 2, sha("1,10"), True) and got[2] == (2, 4, 2, 1, sha("2"), False)
    assert got[3] == (3, 0, 0, 0, sha(""), False) and got[4][2] == 0 and got[5][2:4] == (2, 1)
    split = decontamination.find_contamination(docs(spark, rows), bench, block_bytes=80).select("doc_id", "items")
    assert {r[0]: sorted(r[1]) for r in split.collect()} == {1: ["1", "10"], 2: ["2"], 3: [], 4: [], 5: ["4"]}
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs(spark, rows), bench, min_items=1).collect()) == [3, 4]
    assert decontamination.digest(docs(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_secrets(spark):
    der = bytes([0x30, 21, 2, 1, 0, 4, 16, *range(16)])
    jwt = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"a":1}', b"sig"))
    text = f"é Token = 'abc' api_key:\"abcdef123\" AKIA{'A' * 16} AKIAB {'0af' * 8} -----BEGIN PRIVATE KEY-----\n{base64.b64encode(der).decode()}\n-----END PRIVATE KEY----- {jwt} {(der + b'')[:].hex()}"
    got = secret_scan.scan_secrets(docs(spark, [(1, text)])).first()
    spans = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in got["spans"].split(","))]
    assert (got["n_assign"], got["n_access"], got["n_hex"]) == (1, 1, 2)
    assert ("assign", 'api_key:"abcdef123') in spans and ("access", "AKIA" + "A" * 16) in spans and ("jwt", jwt) in spans and ("hexder", der.hex()) in spans
    assert sum(k == "pem" for k, _ in spans) == 1
    assert not secret_scan.is_der_key(der[:-1] + b"") and not secret_scan.is_signed_token(b"eyJhIjoxfQ")


def test_secrets_within_runs_in_any_case_and_escaped(spark):
    rng = np.random.default_rng(3)
    key = lambda n: (b := bytes([2, 1, 0, 4, 0x82, n >> 8, n & 255]) + rng.integers(0, 256, n, dtype=np.uint8).tobytes()) and b"\x30\x82" + len(b).to_bytes(2, "big") + b
    b64 = lambda x: base64.b64encode(x).decode()
    keys = [key(n) for n in (600, 601, 602)]
    plain = [(f"{before}{k}{after}", "der", k) for x in keys for k in (b64(x), base64.urlsafe_b64encode(x).decode(), b64(x).rstrip("=")) for before, after in (("PRIVATE_KEY=", ""), ("a=b&PRIVATE_KEY=", ""), ("", ""), ("/etc/keys/", ""), ("my-key_", ""), ("+", ""))]
    plain += [(f"K={b64(keys[0])}/x", "der", b64(keys[0])) if b64(keys[0])[-1] != "=" else (f"K={b64(keys[0]).rstrip('=')}/x", "der", b64(keys[0]).rstrip("="))]
    ssh = b64(b"openssh-key-v1\0" + 3 * (b"\0\0\0\4none") + b"\0\0\0\1" + bytes(30))
    plain += [(f"SSH_KEY={ssh}", "der", ssh)]
    plain += [(f"x {h} y", "hexder", h) for h in (keys[0].hex().upper(), keys[0].hex(), keys[0].hex()[:300] + keys[0].hex()[300:].upper())]
    for newline in ("\n", "\\n", "\\r\\n", "\\\\n"):
        lines = newline.join(b64(keys[1])[k : k + 64] for k in range(0, 1000, 64))
        pem = f"-----BEGIN PRIVATE KEY-----{newline}{lines}{newline}-----END PRIVATE KEY-----"
        plain.append((f'"k": "{pem}{newline}"', "pem", pem))
    got = secret_scan.scan_secrets(docs(spark, [(i, t) for i, (t, _, _) in enumerate(plain)])).orderBy("doc_id").collect()
    for r, (text, kind, inside) in zip(got, plain, strict=True):
        found = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert [x for x in found if x[0] in ("der", "hexder", "pem")] == [(kind, inside)], text[:60]
        assert r["n_hex"] == sum(k == "hex" for k, _ in found)
    cut = [f"KEY={b64(keys[0])[:-8]}", f"KEY=x{b64(keys[0])}", f"KEY={b64(keys[0][:-1] + b'xx')}", keys[0].hex()[:-2].upper()]
    assert not any("der" in r["spans"] for r in secret_scan.scan_secrets(docs(spark, list(enumerate(cut)))).collect())


def test_quality(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 50}" for k in range(60))) for i in range(120)]
    junk = [(1000 + i, " ".join(f"word{k}### $$$" for k in range(40))) for i in range(30)]
    rows = good + junk + [(None, "word1 word2"), (2000, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:80]] + [(1000, 0, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_resampling.resample(docs(spark, rows), labels).collect()}
    assert len({i for i, _ in good} & kept) >= 118 and not {i for i, _ in junk} & kept
    assert quality_resampling.resample(docs(spark, rows), labels.limit(0)).count() == len(rows)
    assert quality_resampling.resample(docs(spark, rows).limit(0), labels).count() == 0


def test_quality_is_cut_by_length(spark):
    rng = np.random.default_rng(11)
    text = lambda n, bad: " ".join(f"bad{k}" if b else f"word{k}" for k, b in zip(rng.integers(0, 50, n), rng.random(n) < bad, strict=True))
    good = [(i, text(3000, 0.3 * (i % 3 == 0))) for i in range(60)] + [(100 + i, text(12, 0)) for i in range(60)]
    junk = [(1000 + i, text(12, 1)) for i in range(60)] + [(2000 + i, text(3000, 0.6)) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_resampling.resample(docs(spark, good + junk), labels).collect()}
    assert len({i for i, _ in good} & kept) >= 118 and not {i for i, _ in junk} & kept


def test_quality_scale_covers_all_lengths():
    n = np.concatenate([np.zeros(1200, dtype=np.int64), np.arange(1, 801)])
    scale = quality_resampling.Scale(n, -0.1 * (n + quality_resampling.SLACK), 0.002)
    assert np.allclose(scale.normal(n, -0.1 * (n + quality_resampling.SLACK)), 0) and np.isfinite(scale.normal(np.array([0, 10**6]), np.array([0.0, -5.0]))).all()


@pytest.mark.parametrize("k", [0, 1, 37, 100, 149, 500])
def test_quality_takes_exactly_the_k_largest_keys(spark, k):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'bad' if i % 5 == 0 else 'word'}{x}" for x in rng.integers(0, 40, 5 + i % 60))) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    every = {r["doc_id"]: r["key"] for r in quality_resampling.resample(docs(spark, rows), labels, k=10**9).collect()}
    assert len(every) == 150
    got = quality_resampling.resample(docs(spark, rows), labels, k=k)
    assert {r["doc_id"] for r in got.collect()} == set(sorted(every, key=lambda i: (-every[i], i))[:k])


def test_kth_largest_and_ties(spark):
    xs = [-5, -5, 0, 3, 3, 3, 1 << 62, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for k in range(1, len(xs) + 1):
        want = sorted(xs, reverse=True)[k - 1]
        assert quality_resampling.kth_largest(df, k) == (want, sum(x > want for x in xs))
    keys = spark.createDataFrame([(i, 1.0, 7) for i in (5, 1, 9, None, 3)] + [(0, 0.5, 6), (2, 2.0, 8)], "doc_id long, key double, x long")
    taken = [quality_resampling._line(keys, k).takes(pa.array([5, 1, 9, None, 3, 0, 2]), np.array([1.0] * 5 + [0.5, 2.0])).tolist() for k in (1, 3, 5)]
    assert [[i for i, t in zip((5, 1, 9, None, 3, 0, 2), x, strict=True) if t] for x in taken] == [[2], [1, 3, 2], [5, 1, 9, 3, 2]]


def test_language(spark):
    words = {"en": "the of and that with house water", "de": "der die und nicht mit haus wasser", "fr": "le la et que avec maison eau"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(w.split())), lang, "s", None, "", "") for n, (lang, w) in enumerate(words.items()) for i in range(n * 20, n * 20 + 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language_id.learn(df)
    got = table(language_id.identify(df, model))
    assert all(got[r[0]][1] == r[2] and 0 <= got[r[0]][2] <= 1 for r in rows)
    odd = language_id.identify(docs(spark, [(1, None), (2, "12 ?! —"), (3, "É"), (4, "the " * 50_000 + "x" * 500)]), model)
    assert [r["lang_pred"] for r in odd.orderBy("doc_id").collect()][:2] == ["und", "und"] and table(odd)[3][1] != "und" and table(odd)[4][1] == "en"
    assert table(language_id.identify(df, language_id.learn(df.limit(0))))[0][1:] == ("und", 0.0)


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces([b"a", b"b", b"ab", b"ba", b"aba"])
    p = np.array([[0.3], [0.2], [0.25], [0.15], [0.1], [0.0]])
    value = lambda w: 1.0 if not w else sum(p[i, 0] * value(w[len(x) :]) for i, x in enumerate(pieces.pieces) if w.startswith(x))
    words = [b"a", b"abab", b"ababa"]
    assert np.allclose(np.exp(language_id.word_scores(words, pieces, p))[:, 0], [value(w) for w in words])


def test_jaccard_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [[f"b{g}w{k}" for k in range(60)] for g in range(6)]
    rows = []
    for i in range(90):
        w = list(base[i % 6])
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = f"edit{i}"
        rows.append((i, " ".join(w[: rng.integers(50, 61)]).upper()))
    rows += [(200, "one two"), (201, "ONE  two"), (202, "one"), (203, None), (204, "")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    least = {i: i for i in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    got = table(jaccard_join.similar_components(docs(spark, rows)))
    assert got == {i: (i, len(sets[i]), least[i]) for i in sets}
    assert {r["doc_id"] for r in jaccard_join.keep_one(docs(spark, rows)).collect()} == set(least.values())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(20)]
    rows += [(400, None), (401, [float("nan")] * 8), (402, [1.0, None] + [0.0] * 6), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk_search.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    v = {i: np.floor(256 * np.array(x, dtype=np.float32).astype(np.float64)).astype(int) for i, x in rows[:320]}
    want = [(q, r + 1, c, int(-s)) for q in v if q % 50 == 0 for r, (s, c) in enumerate(sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5])]
    assert got == sorted(want)
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 1.0, 5.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in topk_search.top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2]


def test_top_k_over_many_shards_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(loc=c, scale=0.3, size=(150, 6)) for c in rng.normal(scale=4, size=(8, 6))] + [np.full((600, 6), 1.5)])  # a third are equal
    rows = [(i, [float(c) for c in (v[:4] if i % 7 == 0 else v)]) for i, v in enumerate(x)]  # some are shorter
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(topk_search, "ROOTS", 5)
    met = []
    plain = topk_search.written
    monkeypatch.setattr(topk_search, "written", lambda df, name: met.append((name, plain(df, name))) or met[-1][1])
    monkeypatch.setattr(topk_search, "discard", lambda df: None)
    got = sorted(map(tuple, topk_search.top_k(df, df.where("vec_id % 50 = 0"), shard=16, block=8).collect()))
    v = np.zeros((len(rows), 6), dtype=np.int64)
    for i, e in rows:
        v[i, : len(e)] = np.floor(256 * np.array(e))
    want = [(q, r + 1, c, -s) for q in range(0, len(rows), 50) for r, (s, c) in enumerate(sorted((-int(v[q] @ v[c]), c) for c in range(len(rows)) if c != q)[:5])]
    assert got == sorted(want)
    made = {name: t.count() for name, t in met}
    groups = dict(met)["shards"].select("g").distinct().count()
    assert made["home-cells"] + made["cells"] < groups * made["query-blocks"] * 3 / 4  # the others were never sent; blocks of 8 queries span some clusters


def test_pruning_visits_fewer_nodes():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(loc=c, scale=1, size=(500, 4)) for c in (-400, 0, 400)]).astype(np.int64)
    tree = topk_search.BallTree(np.arange(len(x)), x)
    s = topk_search.Search(np.array([5000]), np.array([[9, 9, 9, 9]]), np.array([topk_search.LEAST]), 5)
    s.descend(tree)
    assert s.visited < len(tree.nodes) / 2


def test_jaccard_parities_never_exceed_the_true_difference():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (3, 30, 80, 400, 400)] + [None, ""]
    sets = jaccard_join.Sets(pa.array(texts, pa.string()), 2)
    parts = [sets.h[sets.first[i] : sets.first[i + 1]] for i in range(len(texts))]
    parity = np.stack(sets.parity(), axis=1).view(np.uint64)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            assert sum(int(x).bit_count() for x in parity[i] ^ parity[j]) <= len(np.setxor1d(a, b))


def clashing(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


BENCH = "item_id long, text string"
#: Each operator on whole rows: (what it takes, the columns that it replaces).
WHOLE = {
    "mix": (lambda spark, d: source_mixing.mix(d), {"copy"}),
    "plan_mix": (lambda spark, d: source_mixing.plan_mix(d), {"size", "source_size", "target", "copies"}),
    "drop_common_lines": (lambda spark, d: line_dedup.drop_common_lines(d), {"n_lines", "n_dropped"}),
    "drop_common_lines, joined": (lambda spark, d: line_dedup.drop_common_lines(d, broadcast_bytes=-1), {"n_lines", "n_dropped"}),
    "resample": (lambda spark, d: quality_resampling.resample(d, spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int"), k=99), {"log_weight", "key"}),
    "find_contamination": (lambda spark, d: decontamination.find_contamination(d, spark.createDataFrame([(1, "x y")], BENCH)), {"n_words", "hit", "items"}),
    "decontaminate": (lambda spark, d: decontamination.decontaminate(d, spark.createDataFrame([(1, "zz zz")], BENCH)), set()),
    "keep_one": (lambda spark, d: jaccard_join.keep_one(d), set()),
}


@pytest.mark.parametrize("name", WHOLE)
def test_clashing_names_nulls_and_repeats(spark, name):
    run, replaced = WHOLE[name]
    given = clashing(docs(spark, ODD))
    out = run(spark, given)
    own = [c for c in CLASHES if c not in replaced]
    found = [r.asDict() for r in out.select("doc_id", "text", *own).collect()]
    assert all(r[c] == f"own {c}" for r in found for c in own)
    ids = [r["doc_id"] for r in found]
    if name == "mix":  # white and null texts have no words, but share a source that has
        assert set(ids) == {i for i, _ in ODD}
    elif name == "keep_one":  # of the repeated row one stays
        assert sorted(ids, key=str) == [1, 2, 3, 4, 5, None]
    else:
        assert sorted(ids, key=str) == [1, 2, 3, 4, 5, 5, None]
    assert run(spark, given.limit(0)).count() == 0


@pytest.mark.parametrize("run", [license_scan.scan_licenses, secret_scan.digest, substring_dedup.digest, source_mixing.digest, line_dedup.digest, lambda d: language_id.identify(d, MODEL)])
def test_digests_ignore_other_columns(spark, run):
    assert sorted(map(tuple, run(clashing(docs(spark, ODD))).collect()), key=str) == sorted(map(tuple, run(docs(spark, ODD)).collect()), key=str)


MODEL = language_id.Model(["aa", "bb"], [b" ", b"x", b"y", b"w"], np.array([[0.2, 0.2], [0.5, 0.1], [0.2, 0.2], [0.1, 0.5], [0, 0]], dtype=np.float32))


def test_keep_one_judges_rows(spark):
    text, near, other = (" ".join(f"{x}{k}" for k in range(60)) for x in ("a", "a", "b"))
    near = near.replace("a59", "edit")
    rows = [(1, text), (2, near), (2, other), (3, other + " x"), (4, text), (4, text), (5, "own words"), (5, "own words"), (6, None), (6, None)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, text), (2, other), (5, "own words"), (6, None), (6, None)], key=str)


def alike(n):
    """A word of a and b, and its complement, which hashes that are polynomials modulo 2 ** 64 can't tell apart if n is 1024 or more."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 256, 512, 1024, 2048, 4096])
def test_words_that_polynomials_confuse(spark, n):
    one, two = alike(n)
    h = Words(Texts(pa.array([one, two])), NOT_SPACE).hashes()
    assert len(one) == n and h[0] != h[1]
    if n == 2048:
        tail = " " + " ".join(f"t{k}" for k in range(12))
        assert {i: x[2] for i, x in table(substring_dedup.digest(docs(spark, [(1, one + tail), (2, two + tail), (3, one + tail)]))).items()} == {1: 0, 2: 0, 3: 13}
        assert {i: x[2] for i, x in table(jaccard_join.similar_components(docs(spark, [(1, one), (2, two), (3, one)]))).items()} == {1: 1, 2: 2, 3: 1}


def test_language_scores_whole_words_by_plain_recursion():
    vocabulary = language_id.read_vocabulary(language_id.VOCABULARY)
    pieces, rng = language_id.Pieces(vocabulary), np.random.default_rng(6)
    p = rng.random((len(vocabulary) + 1, 2))
    p[-1] = 0
    p /= p.sum(axis=0)
    at = {x: i for i, x in enumerate(vocabulary)}
    words = [b" " + bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 5, 40, 100, 700)] + [" 日本語のテキストには空白がない".encode() * 9, b" internationalization"]

    def plain(w, k):
        scaled, logs = [1.0], [0.0]  # values over e ** logs
        for t in range(1, len(w) + 1):
            sums = [(scaled[t - m] * p[at[w[t - m : t]], k], logs[t - m]) for m in range(1, min(t, pieces.longest) + 1) if w[t - m : t] in at]
            top = max(x for _, x in sums)
            value = sum(x * np.exp(e - top) for x, e in sums)
            scaled.append(1.0)
            logs.append(top + np.log(value))
        return logs[-1]

    assert np.allclose(language_id.word_scores(words, pieces, p), [[plain(w, k) for k in range(2)] for w in words], rtol=1e-9)


def test_language_prediction_equals_plain_sums(spark):
    rows = [(1, "xx y xw"), (2, "ww w"), (3, "w x"), (4, "xxxxxxxx")]
    p = {w: MODEL.p[i].astype(float) for i, w in enumerate(MODEL.pieces)}
    got = table(language_id.identify(docs(spark, rows), MODEL))
    for i, t in rows:
        logs = sum(np.log(np.prod([p[b" "], *(p[c.encode()] for c in w)], axis=0)) for w in t.split())
        best = int(np.argmax(logs))
        assert got[i][1] == MODEL.languages[best] and np.isclose(got[i][2], 1 / np.exp(logs - logs[best]).sum(), rtol=1e-4)


SF = "/root/testdata/sf0.01"


def test_license_base_columns_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in license_scan.query(spark, SF).collect()}
    for doc_id, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in found]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(found), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and {x for _, x in found} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_secret_base_columns_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in secret_scan.query(spark, SF).collect()}
    kinds = [("assign", r"""(?ia:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    some = 0
    for doc_id, text in rows:
        found = [(m.start(), n, kind, m.end()) for n, (kind, pattern, group, least) in enumerate(kinds) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        spans = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]
        r = got[doc_id]
        assert r["base_sha256"] == sha(",".join(spans)) and set(spans) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k, *_ in kinds] == [sum(x[2] == k for x in found) for k, *_ in kinds]
        some += len(found)
    assert some


def test_mix_targets_equal_resharing_step_by_step(spark):
    rng = np.random.default_rng(8)
    for _ in range(4):
        sizes = {f"s{k}": int(x) for k, x in enumerate(rng.integers(1, 400, 7) ** 2)} | {None: int(rng.integers(1, 50))}
        order = sorted(sizes, key=lambda x: (x is None, x))
        weight = {x: (1, 2, 3)[k % 3] for k, x in enumerate(order)}
        target, fixed = {}, set()
        while True:  # share what is left by weight; who is above the cap stops there
            left = sum(sizes.values()) - sum(3 * sizes[x] for x in fixed)
            free = [x for x in order if x not in fixed]
            target = {x: 3.0 * sizes[x] if x in fixed else left * weight[x] / sum(weight[y] for y in free) for x in order}
            above = {x for x in free if target[x] > 3 * sizes[x]}
            if not above:
                break
            fixed |= above
        got = source_mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert all(np.isclose(r["target"], target[r["source"]]) for r in got) and len(got) == len(order)


def test_decontamination_of_odd_rows(spark):
    item = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([(1, item), (1, item), (1, "ten eleven"), (2, ""), (None, "x")] , BENCH)
    long = "zz " * 200_000 + item
    rows = [(1, long), (2, None), (3, ""), (4, item), (4, item), (None, "TEN, eleven")]
    got = sorted(((r["doc_id"], r["n_hit"], r["n_items"]) for r in decontamination.digest(clashing(docs(spark, rows)), bench).collect()), key=str)
    assert got == sorted([(1, 9, 1), (2, 0, 0), (3, 0, 0), (4, 9, 1), (4, 9, 1), (None, 2, 1)], key=str)
    blocks = decontamination._blocks_of(spark.createDataFrame([(str(i), "word " * 20) for i in range(50)], "item string, text string"), 400)
    assert sum(b.count() for b in blocks) == 50 and max(b.count() for b in blocks) <= 4
    assert decontamination.digest(docs(spark, ODD).limit(0), bench).count() == 0


def test_top_k_of_repeated_ids_and_other_columns(spark):
    rows = [(0, [1.0, None], "a"), (0, [1.0, 2.0], "b"), (1, [1.0, 1.0], "c"), (2, [float("inf"), 1.0], "d"), (3, [1.0, 1.0], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string")
    got = sorted(map(tuple, topk_search.top_k(df, df.where("vec_id = 0")).collect()))
    assert got == [(0, 1, 1, 3 * 256 * 256), (0, 2, 3, 3 * 256 * 256)]


def test_components(spark):
    from keystrata.llm.graph import components

    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 20)] + [(5, 5)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in least.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_secrets_are_keys_by_their_fields():
    length = lambda n: bytes([n]) if n < 128 else b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    der = lambda tag, *parts: bytes([tag]) + length(sum(map(len, parts))) + b"".join(parts)
    num = lambda *x: der(2, bytes(x))
    big = num(*range(1, 60))
    ec = der(0x30, der(6, b"\x2a\x86\x48\xce\x3d\x02\x01"), der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07"))
    held = der(4, bytes(range(40)))
    keys = [
        der(0x30, num(0), *[big] * 8), der(0x30, num(0), *[big] * 5), der(0x30, num(1), *[big] * 8, der(0x30, der(0x30, big, big, big))),
        der(0x30, num(0), ec, held), der(0x30, num(1), ec, held, der(0xA0, der(0x31)), der(0x81, bytes(30))),
        der(0x30, num(1), held, der(0xA0, der(6, b"\x2a\x03")), der(0xA1, der(3, bytes(66)))), der(0x30, ec, held),
    ]
    assert all(map(secret_scan.is_der_key, keys))
    others = [der(0x30, big, big), der(0x30, ec, der(3, bytes(66))), der(0x30, num(2), ec, held), der(0x30, num(0), ec), der(0x30, num(0), ec, held, big), der(0x30, num(0), *[big] * 3), der(0x30, num(0), der(0x30, big), held)]
    assert not any(map(secret_scan.is_der_key, [*others, *(k + b"\0" for k in keys), *(k[:-1] for k in keys)]))
    for cut in (1, 3, 6, 8):  # a nested length that doesn't add up
        assert not secret_scan.is_der_key(keys[3][:cut] + bytes([keys[3][cut] ^ 0x55]) + keys[3][cut + 1 :])


def test_secrets_wrapped_without_armour_and_with_headers(spark):
    rng = np.random.default_rng(5)
    b = bytes([2, 1, 1, 4, 0x82, 2, 88]) + rng.integers(0, 256, 600, dtype=np.uint8).tobytes()
    key = base64.b64encode(b"\x30\x82" + len(b).to_bytes(2, "big") + b).decode()
    wrap = lambda s, n, new: new.join(s[k : k + n] for k in range(0, len(s), n))
    sealed = wrap(base64.b64encode(rng.bytes(640)).decode(), 64, "\n")
    armour = lambda body: f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    plain = [(f"é k =\n{w}\nnext", "der", w) for w in (wrap(key, n, new) for n in (64, 76) for new in ("\n", "\r\n"))]
    plain += [(x, "pem", x) for x in (armour(wrap(key, 64, "\n")), armour(headers + sealed))]
    plain += [(x, None, None) for x in (armour(sealed), armour(headers + sealed[:-5]), wrap(key[:-70], 64, "\n"), wrap(key, 64, "\n\n"), wrap("A" + key, 64, "\n"))]
    got = secret_scan.scan_secrets(docs(spark, [(i, t) for i, (t, _, _) in enumerate(plain)])).orderBy("doc_id").collect()
    for r, (text, kind, inside) in zip(got, plain, strict=True):
        found = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert found == ([(kind, inside)] if kind else []), text[:60]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_licenses_need_all_their_wording(spark):
    texts = [MIT, MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "Foundation"), MIT.replace("merge, ", ""), MIT[:-9], MIT[:400]]
    got = license_scan.scan_licenses(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit,mit-full"] * 2 + ["mit"] * 3
    assert [r["score"] == 1.0 for r in got] == [True, True, False, False, False]


@pytest.mark.parametrize("label", [x for x in license_scan.TEMPLATES if x.endswith("-full")])
def test_whole_licenses_accept_themselves(label):
    for t in license_scan.TEMPLATES[label]:
        words = re.sub(r"<<var \d+>>", "some one", re.sub(r"<</?opt>>", " ", t)).split() if label != "gpl-notice-full" else re.sub(r"<<var \d+>>", "x", re.sub(r"<</?opt>>", " ", t)).split()
        a = license_scan.Automaton(t)
        assert a.match(lambda k: words[k].encode(), 0, len(words)) == len(words)
        assert a.match(lambda k: words[k].encode(), 0, len(words) - 1) is None


def filled_buffer(n_docs, words):
    """A buffer of distinct documents, three of which repeat one."""
    held = jaccard_join._Buffer(7, 64, 0)
    for k in range(0, n_docs, 25):
        rows = [" ".join(f"{i}x{j}" for j in range(words)) for i in range(k, k + 25)] + ["a b c d e f g"]
        held.add(pa.array(range(k, k + 26), pa.int64()), pa.array([0] * 26, pa.int64()), jaccard_join.Sets(pa.array(rows), 5))
    return held


def test_a_buffer_is_sent_whole_in_small_batches_and_within_bounded_memory():
    import tracemalloc

    held = filled_buffer(100, 10_000)
    h, node, n = np.concatenate(held.h), np.concatenate(held.node), held.size
    tracemalloc.start()
    sent = held.sent()
    batches = [sent] if isinstance(sent, pa.RecordBatch) else list(sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = []
    for at, kind, name, payload in (r.values() for b in batches for r in b.to_pylist()):
        assert name == 7
        arrays = jaccard_join.unpacked(payload)
        if kind == jaccard_join._POSTINGS:
            prints = np.cumsum(arrays[0], dtype=np.uint32)
            got += zip([at] * len(prints), prints.tolist(), arrays[1].tolist(), strict=True)
        else:
            assert at < 0 and len(arrays[0]) == 104
    where = ((h >> np.uint64(32)) * np.uint64(64)) >> np.uint64(32)
    assert sorted(got) == sorted(zip(where.tolist(), (h & np.uint64(0xFFFFFFFF)).tolist(), node.tolist(), strict=True))
    assert len(batches) > 2 and max(sum(len(x.as_py()) for x in b.column(3)) for b in batches) < 2 * jaccard_join.SENT_BYTES
    assert peak < 50 * n


def test_freed_memory_is_given_back_when_a_task_ends():
    from keystrata.llm.shared import released

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) >> 8

    last, seen = [], []

    def run(batches):
        for batch in batches:
            held = [np.ones(65_536, dtype=np.uint8) for _ in range(3000)]
            last.append(held[-1])  # the allocator can't shrink its heap by itself
            del held
            seen.append(resident())
            yield batch

    assert list(released(run)(iter([1]))) == [1]
    assert resident() < seen[0] - 100
