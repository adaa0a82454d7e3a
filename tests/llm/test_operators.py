"""The ten operators on small tables with every odd case, against plain Python."""

import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tierflow.llm import (decontamination, fingerprints, line_dedup, packing, simhash, substring_dedup, suffix_dedup, token_counts,  # noqa: E402
                          tokens, toxicity, url_filter)

PASSAGE = " ".join(f"word{i} of the shared passage" for i in range(14))
ODD = [" x   y", "don't <|endoftext|> stop!", "á İ ß 한국", "\x1c a\x85b", "tab\tnew\nline  two", "!!!???", "\0nul \0"]
LINE = "This line stands in many documents, nearly as it is here."
TEXTS = [None, "", "one", "one two", PASSAGE, PASSAGE + " end", "Begin " + PASSAGE, PASSAGE.replace("word7", "other7"), *ODD,
         LINE + "\nfirst own line of this document", LINE.replace("many", "mant") + "\nsecond own line of that document",
         LINE + "\n" + LINE + "\nshort", "ab" * 200, "ab" * 150 + "c", ("long text " + PASSAGE + " ") * 300, "x" * 5000, PASSAGE.upper()]
DOCS = [(i * 3 % 31, t) for i, t in enumerate(TEXTS)] + [(4, PASSAGE), (4, PASSAGE), (None, PASSAGE), (None, LINE), (None, None), (77, TEXTS[8])]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    odd = ["b", "s", "round", "payload", "fp", "key", "fingerprint", "component_id", "n_bytes", "score", "hits", "row", "g", "length", "suffix"]
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3).withColumns({c: F.lit(None).cast("int") if c in "bs" else F.lit(c) for c in odd})


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def same(got, want):
    assert got == sorted(want, key=repr)


def test_fingerprints(docs):
    got = fingerprints.fingerprints(docs)
    same(rows(got, "doc_id", "fingerprint"), [(i, brute.order_minhash(t)) for i, t in DOCS])


def test_next_and_edit(spark, docs):
    plain = [(i, t or "") for i, t in DOCS]
    got = fingerprints.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), {"text": "after"})
    have = rows(got.withColumn("e", fingerprints.edited(F.col("text"), F.col("after"))), "doc_id", "text", "after", "e")
    down = sorted(plain, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = [(i, t, n, t[:len(t) - len(t) // 3] + n[:len(t) // 3]) for (i, t), (_, n) in zip(down, down[1:] + down[:1])]
    same(have, want)
    one = spark.createDataFrame([(5, "abcdef")], SCHEMA)
    assert rows(fingerprints.with_next(one, {"text": "after"}), "after") == [("abcdef",)]


def test_likeness_follows_order(spark):
    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join(f"w{i}" for i in (*range(150, 300), *range(150)))
    c = a.replace("w7 ", "v7 ")
    x = spark.createDataFrame([(a, b, c, a)], "a string, b string, c string, d string").select(
        *[fingerprints.likeness(fingerprints.order_minhash(F.col("a")), fingerprints.order_minhash(F.col(k))).alias(k) for k in "bcd"]).first()
    assert x["d"] == 1 and x["c"] > .85 and x["b"] < .8


def test_no_python_in_fingerprints(docs):
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_token_counts(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in DOCS]
    same(rows(token_counts.token_counts(docs, batch_bytes=100), "doc_id", "n_bytes", "n_tokens", "over_limit"),
         [(i, len((x or "").encode()), k, k > 1024) for (i, x), k in zip(DOCS, n)])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_encoder_is_the_library(name):
    own = tokens.Encoder(public_tokenizers.path(name))
    texts = [t or "" for t in TEXTS] + ["<|startoftext|> A<|endoftext|>b 's'S", "Mr. A's 12,5 km; it's", "été, no."]
    if name.endswith(".model"):
        import sentencepiece
        want = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(texts)
    else:
        t = Tokenizer.from_file(public_tokenizers.path(name))
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want and own.lengths(texts) == [len(x) for x in want]


def test_safe_pieces():
    text = "ab cd  ef, gh ij " * 50
    pieces = tokens.safe_pieces(text, 20)
    assert len(pieces) > 10 and "".join(pieces) == text and tokens.safe_pieces("x" * 99, 20) == ["x" * 99]


def test_simhash(docs):
    ids, prints = [i for i, _ in DOCS], [brute.simhash(t) for _, t in DOCS]
    part = brute.reachable(len(DOCS), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {p: min((ids[k] for k in range(len(ids)) if part[k] == p and ids[k] is not None), default=None) for p in set(part)}
    same(rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id"),
         [(i, f"{f:016x}", least[p]) for i, f, p in zip(ids, prints, part)])
    stay = simhash.one_of_each(docs)
    assert stay.columns == docs.columns and rows(stay, "doc_id") == sorted([(least[p],) for p in set(part)], key=repr)


def test_vantage_forest_loses_no_link(spark, docs):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(9)]
    fp = np.unique(np.concatenate([base, *flips]))
    want = brute.reachable(len(fp), lambda i, j: (int(fp[i]) ^ int(fp[j])).bit_count() <= 3)
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    from tierflow.llm.components import components
    for leaf, block in ((4096, 4096), (40, 16)):
        got = {r["node"]: r["root"] for r in components(simhash.links(table, 3, leaf, block)).collect()}
        root = [got.get(int(x), int(x)) for x in fp.view(np.int64)]
        assert len(set(zip(want, root))) == len(set(want)) == len(set(root))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_band_distance_and_segments(edits):
    rng = np.random.default_rng(edits)
    words = [bytes(rng.choice(list(b"abc"), rng.integers(0, 12))) for _ in range(120)]
    a, b = [w for w in words for _ in range(40)], [words[i] for _ in words for i in rng.integers(0, 120, 40)]

    def pad(x):
        out = np.zeros((len(x), max(map(len, x))), np.uint8)
        for k, t in enumerate(x):
            out[k, :len(t)] = np.frombuffer(t, np.uint8)
        return out, np.array([len(t) for t in x])
    want = [brute.levenshtein(x, y) <= edits for x, y in zip(a, b)]
    assert line_dedup.within(*pad(a), *pad(b), edits).tolist() == want
    for x, y, near in zip(a, b, want):
        if near and min(len(x), len(y)) > edits:
            (ox, ax), (oy, ay) = line_dedup.keys(x, edits), line_dedup.keys(y, edits)
            assert set(ox) & set(ay) or set(oy) & set(ax)


def test_line_dedup(docs):
    gone = brute.lines_removed(DOCS)
    out = line_dedup.line_dedup(docs, lines="n_lines", removed="n_removed")
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    same(rows(out, "doc_id", "n_lines", "n_removed", "text", "key"),
         [(i, len((t or "").split("\n")), len(g), "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in g), "key")
          for (i, t), g in zip(DOCS, gone)])


def test_line_dedup_of_short_lines(spark, docs):
    data = [(2, "All rights reserved.\nown\n\nCookies\n\nCookies"), (1, "x\nAll rights reserved."), (3, "Cookie\n\u00e9\nx\n" + LINE), (None, "\u00e9\n" + LINE.replace("many", "mant"))]
    out = line_dedup.line_dedup(spark.createDataFrame(data, SCHEMA).repartition(3), removed="n", exact=1)
    assert {r["doc_id"]: (r["text"], r["n"]) for r in out.collect()} == {
        1: ("x\nAll rights reserved.", 0), 2: ("own\n\nCookies\n", 2), 3: ("Cookie\n\u00e9\n" + LINE, 1), None: ("", 2)}
    first = {}
    for i, t in DOCS:
        for k, x in enumerate((t or "").split("\n")):
            first[x] = min(first.get(x, (brute.order(i), k)), (brute.order(i), k))
    gone = [g | {k for k, x in enumerate((t or "").split("\n")) if x and first[x] < (brute.order(i), k)} for (i, t), g in zip(DOCS, brute.lines_removed(DOCS))]
    same(rows(line_dedup.line_dedup(docs, removed="n", exact=1), "doc_id", "n"), [(i, len(g)) for (i, _), g in zip(DOCS, gone)])


def test_suffix_dedup(docs):
    gone = brute.cut_windows(DOCS, lambda t: (t or "").encode(), 50, False)
    got = suffix_dedup.suffix_dedup(docs).withColumn("n", F.size("spans"))
    same(rows(got, "doc_id", "n_bytes", "n_removed", "n", "kept_sha256"),
         [(i, len(b := (t or "").encode()), len(g), brute.runs(g), brute.sha(bytes(x for k, x in enumerate(b) if k not in g)))
          for (i, t), g in zip(DOCS, gone)])


def test_two_stage_sort():
    rng = np.random.default_rng(1)
    for alphabet in (b"ab", b"abcdefgh", bytes(range(256))):
        text = bytes(rng.choice(list(alphabet), 400)) + bytes(20) + b"a" * 40
        data = np.frombuffer(text + bytes(64), np.uint8)
        wanted = np.zeros(len(data), bool)
        wanted[:400] = True
        got = suffix_dedup.two_stage(data, wanted, 56)
        keys = [bytes(data[i:i + 50]) for i in got]
        assert sorted(got.tolist()) == list(range(400)) and keys == sorted(keys)


def test_substring_dedup(docs):
    gone = brute.cut_windows(DOCS, lambda t: (t or "").encode().split(), 20, True)
    same(rows(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256"),
         [(i, len(w := (t or "").encode().split()), len(g), brute.sha(b" ".join(x for k, x in enumerate(w) if k not in g)))
          for (i, t), g in zip(DOCS, gone)])


def test_packing(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, x in DOCS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, s, len(p := ids[s:s + 4096]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    out = packing.pack(docs)
    same(rows(out, "doc_id", "piece", "start", "length", "ids_crc32"), want)
    held = {}
    for s, o, n in rows(out, "sequence_id", "offset", "length"):
        held.setdefault(s, []).append((o, n))
    for x in held.values():
        x.sort()
        assert all(o == sum(n for _, n in x[:k]) for k, (o, _) in enumerate(x)) and sum(n for _, n in x) <= 4096
    assert len(held) == -(-sum(w[3] for w in want) // 4096)


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(5)
    size = rng.integers(1, 60, 400).astype(float)
    demand, capacity = np.stack([size, np.ones(400), size * size], 1), np.array([100., 5., 4000.])
    bins, offset = packing.best_fit(demand, capacity, rule)
    used = np.stack([np.bincount(bins, demand[:, d]) for d in range(3)], 1)
    assert (used <= capacity).all() and len(used) <= 1.15 * np.ceil((demand.sum(0) / capacity).max())
    for b in range(len(used)):
        o = np.argsort(offset[own := bins == b])
        assert (offset[own][o] == np.cumsum(size[own][o]) - size[own][o]).all()


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(1500):
        sentences = [" ".join(f"w{k}" for k in rng.integers(0, 300, 8)) for _ in range(rng.integers(1, 6))]
        bad = int(rng.random() < .2)
        if bad:
            sentences[0] += " vileword you"
        data.append((i, ". ".join(sentences) + ".", bad))
    docs = spark.createDataFrame([d[:2] for d in data] + [(None, None), (2000, ""), (2001, "vileword here. fine words."), (2001, "vileword here. fine words.")], SCHEMA)
    labels = spark.createDataFrame([(i, b) for i, _, b in data] + [(None, 1), (3, None), (5, 7)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [i for i, *_ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in data)
    assert np.mean([got[i]["predicted"] == data[i][2] for i in held]) > .97
    assert got[2000]["score"] < .5 and got[None]["score"] < .5 and got[2001]["predicted"] == 1
    span = got[2001]["sentences"]
    assert [(x["start"], x["end"]) for x in span] == [(0, 14)]
    assert toxicity.without_toxic(docs, labels).where("doc_id = 2001").count() == 0
    assert toxicity.score(docs, labels.limit(0)).agg(F.max("score")).first()[0] < .5


def test_decontamination(spark, docs):
    items = [(1, "Alice has 5 apples and gives 2 apples to Mr Bob who then walks 10 km home to tell Alice."), (2, "What is it?"),
             (3, "the river bends slowly past nine old mills and a quiet red barn near town"), (None, None), (4, "short words only here now")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    cases = {1: ("So Carol has 7 apples and gives 3 apples to Mr Dan who then walks 12 miles home to tell Carol about.", True),
             2: ("Carol has 7 apples and gives 7 apples to Mr Dan who then walks 12 miles home to tell Erin about.", False),
             3: ("Intro. The river bends slowly past nine old mills and a quiet red barn.\nMore", True), 4: ("What is it? What is it?", False), 5: ("", False),
             6: (None, False), 7: ("He said: Short words only here now", True), 8: ("river past nine mills, slowly; old bends and a red quiet barn town near the", False)}
    found = decontamination.contamination(spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], SCHEMA), bench)
    assert {r["doc_id"]: r["contaminated"] for r in found.collect()} == {i: bad for i, (_, bad) in cases.items()}
    small = decontamination.contamination(spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], SCHEMA), bench, block_bytes=40)
    assert rows(found, "doc_id", "contaminated") == rows(small, "doc_id", "contaminated")
    left = decontamination.decontaminated(docs, bench)
    assert left.columns == docs.columns and rows(left, "doc_id", "text") == rows(docs, "doc_id", "text")
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def leaks(spark, items, cases):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontamination.contamination(spark.createDataFrame(list(enumerate(t for t, _ in cases)), SCHEMA), bench)
    got = {r["doc_id"]: sorted({h["item_id"] for h in r["hits"]}) for r in found.collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_names_that_begin_sentences(spark):
    leaks(spark, ["Tom has 5 apples. Tom eats 2 apples. How many apples are left?", "What is the capital of France?"], [
        ("Sara has 7 apples. Sara eats 3 apples. How many apples are left?", [0]), ("so Sara has 7 apples. Mike eats 3 apples. how many were left", []),
        ("Quiz (What is the capital of France?)", [1]), ("Q1) what is the capital of France", [1]), ("WHAT else is a capital of France", []),
        ("Tom has 5 apples. Tom eats 2 apples. And how many apples", []), ("Tom\n" * 3000 + "Sara\nTom\n" * 2000, [])])


def test_items_with_few_plain_tokens(spark):
    leaks(spark, ["What comes next: 2, 4, 8, 16, 32, 64, 128?", "Calculate 12 + 35 - 7", "3 + 4 + 5", "\u5c0f\u660e\u6709\u4e94\u4e2a\u82f9\u679c\uff0c\u5403\u4e86\u4e00\u4e2a"], [
        ("Quiz. What comes next: 2, 4, 8, 16, 32, 64, 128? Think.", [0]), ("What comes next: 3, 6, 12, 24, 48, 96, 192?", [0]),
        ("What comes next: 3, 6, 12, 24, 12, 96, 192?", []), ("calculate 12 + 35 - 7 now", [1]), ("Calculate 12 + 35 + 7", []), ("Calculate 1 + 2 - 8", [1]),
        ("it is 3 + 4 + 5 here", [2]), ("it is 3 + 4 + 6 here", []),
        ("\u9898\u76ee\uff1a\u5c0f\u660e\u6709\u4e94\u4e2a\u82f9\u679c\uff0c\u5403\u4e86\u4e00\u4e2a\u3002", [3]), ("\u5c0f\u660e\u6709\u4e94\u4e2a", [])])


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/1?x=1", "http://www.example.com/en/a", "http://com/en/", "http://x.com", "http://xcom/en/",
            "https://a.net/es/1#f", "https://a.net/fr/", "http://NET/es/", "http://h.org/en/?q", "http://u?://v.com/", "http://h/a#b?c"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2 + [(None, "http://b.com/x")], "page_id bigint, url string").withColumns(
        {c: F.lit(1) for c in ("host", "path", "features", "label", "suffix")})
    want = {0: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("a.example.com", "/en/1", "example.com/en/"), 5: ("www.example.com", "/en/a", "www.example.com/en/"),
            6: ("com", "/en/", "com/"), 7: ("x.com", "", None), 8: ("xcom", "/en/", None), 9: ("a.net", "/es/1", "net/es/"), 11: ("net", "/es/", "net/es/"),
            13: ("u", "", None), 14: ("h", "/a", None)}
    got = url_filter.judge(pages).collect()
    assert len(got) == 2 * len(urls) + 1
    for r in got:
        if r["page_id"] in want:
            assert (r["host"], r["path"], r["rule"]) == want[r["page_id"]]
        if r["rule"]:
            assert r["verdict"] == ("allow" if r["rule"] in ("com/", "www.example.com/en/") else "block")
        assert r["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in url_filter.judge(pages.where("url like '%net%'")).collect()} == {"block"}


def test_url_trees_learn(spark):
    data = [(i, f"http://s{i % 40}.example.{'net' if i % 3 else 'com'}/{('es/' + 'p' * (i % 9) + str(i)) if i % 3 else 'de/' + str(i)}") for i in range(900)]
    got = url_filter.judge(spark.createDataFrame(data, "page_id bigint, url string")).collect()
    wrong = sum((r["block_probability"] >= .5) != (r["verdict"] == "block") for r in got if r["rule"])
    assert wrong < .02 * len(got)


def test_empty_tables(spark, docs):
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int")
    bench, pages = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([], "page_id bigint, url string")
    for out in (fingerprints.with_next(fingerprints.fingerprints(none), {"text": "after"}), token_counts.token_counts(none), simhash.near_duplicates(none),
                simhash.one_of_each(none), line_dedup.line_dedup(none), suffix_dedup.suffix_dedup(none), substring_dedup.substring_dedup(none),
                toxicity.score(none, labels), toxicity.without_toxic(none, labels), decontamination.contamination(none, bench),
                decontamination.decontaminated(none, bench), packing.pack(none), url_filter.judge(pages)):
        assert out.count() == 0 and out.columns
