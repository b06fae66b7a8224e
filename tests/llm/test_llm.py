"""The operators on text against brute force, and on degenerate input: nulls, empty and long texts, ties, repeated rows, empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import bpe, decontaminate, graph, hamming_topk, jaccard_join, kernels, langid, lm_scoring, pii, queries, sharding, toxicity, url_filter
from strandline.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOWER))


ODD = ["", None, "   ", "one", "one two", "é ß\u00a0ñ 日本語", "A a A a " * 2000, "x" * 50_000, "a@b.c_d@e.f +1 (415) 555-0123 4111 1111 1111 1111 1.2.3.4", "same text here", "same text here", "\x0b\x0c tabs\tand\nlines"]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with odd texts, repeated rows, a null id and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, "no id"), (None, None)]
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60").collect()]
    rows += [(i + 1000, t) for i, t in real]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.length("text").alias("n_chars"), F.lit(1).alias("node"), F.lit(2).alias("key"), F.lit("x").alias("spans"), F.lit(7).alias("c0"))


def empty(docs):
    return docs.where("false")


def test_components_both_ways(spark):
    rng = random.Random(1)
    edges = spark.createDataFrame([(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(900, 930)], "a long, b long")
    one, many = (sorted(map(tuple, graph.components(edges, Scratch(spark), few=n).collect())) for n in (10**6, 0))
    assert one == many


def brute_windows(items, window=10):
    out = collections.defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            out[tuple(w[k : k + window])].add(str(i))
    return out


def test_decontamination(spark, docs):
    source = [t for t in ODD if t] + [r["text"] for r in docs.where("doc_id > 1000").limit(3).collect()]
    items = [(1, "one"), (2, " ".join(words(source[-1], ALNUM)[5:25])), (3, None), (4, "!!"), (2, "tabs and"), (9, "日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs, bench, carried=("doc_id",)).collect()
    windows = brute_windows(items)
    for r in got:
        w, hit, found = words(r["text"], ALNUM), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found))
    cleaned = decontaminate.remove(docs, bench)
    assert cleaned.columns == docs.columns and cleaned.count() < docs.count()
    assert decontaminate.matches(docs, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.remove(empty(docs), bench).count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(docs.where("doc_id > 1000").limit(12).collect())], "item_id long, text string")
    one = sorted(map(str, decontaminate.matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted(map(str, decontaminate.matches(docs, bench).collect())) == one


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://com/en/", "nothing", None, "x://h#f", "x://h/en/?a", "ftp://u@b.co.uk:80/p\nq", "http://notcom/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 0) for i in range(4)] + [(1, None)], "doc_id long, good int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, outcomes).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[1]["rule"], got[1]["verdict"]) == ("com/en/", "block") and (got[2]["host"], got[3]["path"]) == ("", "")
    assert (got[4]["host"], got[4]["path"]) == ("h", "") and got[6]["host"] == "u@b.co.uk:80" and got[6]["path"] == "/p\nq" and got[7]["rule"] is None
    assert url_filter.judge(pages.where("false"), outcomes.where("false")).count() == 0
    many = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good'}.org/{i}") for i in range(120)], "page_id long, url string")
    marks = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, good int")
    verdicts = {(r["host"], r["verdict"]) for r in url_filter.judge(many, marks).collect()}
    assert verdicts == {("bad.org", "block"), ("good.org", "allow")}


def test_hamming_search(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 40))
    vectors[50:200] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(300, None), (301, []), (7, vectors[7].tolist())]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in hamming_topk.search(base, base.where("vec_id % 25 = 0"), k=6).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    code = {i: np.array([x > 0 for x in (v or [])] + [False] * (40 - len(v or []))) for i, v in rows if v is not None}
    ids = [i for i, v in rows if v is not None]
    want = {q: sorted((int((code[q] != code[i]).sum()), i) for i in ids)[:6] for q in ids if q % 25 == 0}
    assert dict(got) == want and 300 not in got
    assert hamming_topk.search(base.where("false"), base).count() == 0


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def test_pii_spans(spark, docs):
    extra = spark.createDataFrame([(-1, "a" * 30_000 + " " + "1" * 20_000 + "@x.y"), (-2, "1 2 " * 3000), (-3, "x@" + "b." * 20_000 + "c"), (-4, "+1" + " " * 20_000), (-5, "1.2.3.4.5 001.255.3.4 256.1.1.1 é 4111-1111-1111-1112")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    texts = collections.defaultdict(list)
    for r in both.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for r in pii.digests(both).collect():
        wants = []
        for text in texts[r["doc_id"]]:
            found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text) if valid(kind, m.group()))
            wants.append(([sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{z}" for a, k, z in found).encode()).hexdigest()))
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) in wants


def test_pii_terms_and_text(spark):
    rows = [(i, f"note {i} secretword for ann@x.org plain words here") for i in range(4)] + [(10 + i, f"plain words here number {i}") for i in range(60)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    out = {r["doc_id"]: r for r in pii.sanitised(df).collect()}
    assert out[0]["text"] == "note 0 <TERM> <TERM> <EMAIL> plain words here".replace("note", "<TERM>", 1) and out[0]["n_chars"] == len(out[0]["text"])
    assert out[10]["text"] == "plain words here number 0" and out[99]["text"] is None and out[98]["text"] == ""
    assert pii.sanitised(df.where("false")).count() == 0


def slow_terms(texts, threshold):
    """Places of disclosing terms in each different text, by counting every pair of an entity and a word."""
    held, words_of, base = collections.defaultdict(set), {}, collections.defaultdict(list)
    for t in texts:
        low = t.translate(LOWER)
        words_of[t] = set(ALNUM.findall(low))
        for k, (kind, p) in enumerate(KINDS):
            for m in re.finditer(p, t):
                if valid(kind, m.group()):
                    base[t].append(m.span())
                    held[k, re.sub("[^0-9]", "", m.group()) if k >= 2 else m.group().translate(LOWER)].add(t)
    d = collections.Counter(w for ws in words_of.values() for w in ws)
    strong, n = collections.defaultdict(set), len(texts)
    for with_e in held.values():
        de = len(with_e)
        c = collections.Counter(w for t in with_e for w in words_of[t] - {v for a, z in base[t] for v in ALNUM.findall(t[a:z].translate(LOWER))})
        for w, k in c.items():
            if n > de and math.log(k * n / (d[w] * de)) >= threshold * math.log(n / de):
                for t in with_e:
                    if w in words_of[t]:
                        strong[t].add(w)
    out = {}
    for t in texts:
        inside = {v for a, z in base[t] for v in ALNUM.findall(t[a:z].translate(LOWER))}
        out[t] = [m.span() for m in ALNUM.finditer(t.translate(LOWER)) if m.group() in strong[t] - inside and not any(a < m.end() and m.start() < z for a, z in base[t])]
    return out


def test_pii_terms_against_all_pairs(spark):
    rng = random.Random(7)
    texts = []
    for i in range(90):
        ws = [rng.choice(["Alpha", "beta", "gamma", "délta", "rare%d" % rng.randrange(40), "uniq%d" % i, "Xa%d" % rng.randrange(12)]) for _ in range(rng.randrange(1, 25))]
        ws += [rng.choice(["a%d@x.org" % rng.randrange(6), "10.0.0.%d" % rng.randrange(4), "éa1@x.org", "uniq@b.co", "+1 415 555 01%02d" % rng.randrange(3)]) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
        rng.shuffle(ws)
        texts.append(" ".join(ws))
    texts += texts[:9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.95, 0.47):
        want = slow_terms(sorted(set(texts)), threshold)
        assert any(want.values())
        for r in pii.spans(df, carried=("text",), threshold=threshold).collect():
            assert [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == 4] == want[r["text"]], threshold


def test_pii_text_with_many_values(spark):
    """Replacement against slicing, over texts longer than a block with more spans than are taken at a time."""
    parts = ["é" * (i % 7) + f" x{i}@y{i % 50}.org " + "word " * (i % 11) + ("1.2.3.4@q.io " if i % 5 == 0 else "") for i in range(900)]
    text = "".join(parts)
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, text + "z" * 5000), (4, "a@b.c")], "extra long, text string").withColumns({"base": F.lit(1), "_text": F.lit(2), "key": F.lit(3), "changed": F.lit(4), "c0": F.lit(5), "text_id": F.lit(6)})
    got = {r["extra"]: r for r in pii.sanitised(df).collect()}
    marked = {r["extra"]: r["spans"] for r in pii.spans(df, carried=("extra",)).collect()}
    assert len(marked[1]) > 900 and got[2]["text"] == "plain" and all(tuple(r)[2:] == (1, 2, 3, 4, 5, 6) for r in got.values())
    for i, t in ((1, text), (3, text + "z" * 5000), (4, "a@b.c")):
        out, at = [], 0
        for s in marked[i]:
            if s["start"] >= at:
                out += [t[at : s["start"]], f"<{pii.KINDS[s['kind']].upper()}>"]
            at = max(at, s["stop"])
        assert got[i]["text"] == "".join(out) + t[at:]


def test_pii_terms_of_values_in_one_text(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["text"] or "" for r in df.collect()}
    held, count = collections.defaultdict(set), collections.Counter(w for t in texts for w in set(words(t, ALNUM)))
    for t in texts:
        for k, (kind, p) in enumerate(KINDS):
            for m in re.finditer(p, t):
                if valid(kind, m.group()):
                    held[k, re.sub("[^0-9]", "", m.group()) if k >= 2 else m.group().translate(LOWER)].add(t)
    assert held and max(map(len, held.values())) == 1  # nothing recurs: a floor on recurrence finds no term
    holders = {t for ts in held.values() for t in ts}
    n, marked = len(texts), 0
    for r in pii.spans(df, carried=("doc_id", "text")).collect():
        t = r["text"] or ""
        base = [(s["start"], s["stop"]) for s in r["base"]]
        inside = {w for a, z in base for w in words(t[a:z], ALNUM)}
        strong = {w for w in words(t, ALNUM) if w not in inside and math.log(n / count[w]) / math.log(n) >= pii.THRESHOLD} if t in holders else set()
        want = [m.span() for m in ALNUM.finditer(t.translate(LOWER)) if m.group() in strong and not any(a < m.end() and m.start() < z for a, z in base)]
        assert [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == 4] == want
        marked += len(want)
    assert marked


def test_bpe_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    extra = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, "a <|endoftext|> b's it's  x \n\n y"), (-2, "née Älter ÿ ſa \u0301a İ 12 ab")], "doc_id long, text string"))
    ids = bpe.encoded(extra, kept=("doc_id", "text"))
    for r in ids.collect():
        assert r["ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    for r in bpe.decoded(ids.withColumnRenamed("text", "was"), kept=("was",)).collect():
        assert r["text"] == (r["was"] or "")
    assert bpe.round_trip_digests(empty(docs)).count() == 0


def test_bpe_cuts_where_the_tokenizer_does():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(5)
    parts = ["a", "Bc", " ", " ", "  ", "\n", "\t", "'s", "'ll", "'", ",", ".", "...", "!?", ")", "(", "12", "é", "ñß", "×", "\u0301", "Я", "日本", "\u00a0", "\u3000", "\x1c", "\x85", "<|endoftext|>", "<|", "_", "😀", "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    words, n = bpe.cut(pa.array(texts, pa.large_string()))
    words, at = words.to_pylist(), 0
    for text, k in zip(texts, n.tolist(), strict=True):
        mine = words[at : at + k]
        at += k
        assert "".join(mine) == text
        assert [i for w in mine for i in t.encode(w, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids
    assert at == len(words) > len(texts)


def test_pipeline_encodes_and_decodes(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    named = docs.withColumn("source", F.lit("s"))
    texts = collections.defaultdict(set)
    for r in named.collect():
        texts[r["doc_id"]].add(r["text"] or "")
    out = corpus_pipeline.STAGES[-1][1](spark, named, SF).collect()
    assert len(out) == named.count()
    for r in out:
        text = t.decode(r["ids"], skip_special_tokens=False)
        assert text in texts[r["doc_id"]] and r["ids"] == t.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["round_trip"] and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_sharding(spark, docs):
    for law in ("rows", "key"):
        out = sharding.shard(docs, 8, law).collect()
        by = collections.defaultdict(list)
        for r in out:
            by[r["shard"]].append(r["slot"])
        assert len(out) == docs.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
        if law == "rows":
            sizes = [len(by[s]) for s in range(8)]
            assert max(sizes) - min(sizes) <= 1
        else:
            assert {r["grown_shard"] for r in out if r["grown_shard"] != r["shard"]} <= {8}
    text = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id > 1000").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]].encode()) + 1, zlib.crc32(text[r["doc_id"]].encode())) for r in out if r["doc_id"] in text)
    assert sharding.shard(empty(docs)).count() == 0
    hot = spark.range(2000).select(F.lit(5).alias("doc_id"), F.lit("t").alias("text"))
    assert {r["count"] for r in sharding.shard(hot).groupBy("shard").count().collect()} == {250}


def slow_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and any(text[i : i + k] in s for s in sample):
            k += 1
        i += max(k - 1, 1)
        n += 1
    return n


def test_language_phrases_against_slow_parsing(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(langid, "LANE", 16)
    wide = [chr(0x4E00 + i) for i in range(300)]  # far more letters than table columns
    for dense in (62, 3):
        monkeypatch.setattr(langid, "DENSE", dense)
        model = langid.Model({"a": ["abra cadabra", "alakazam"], "b": ["hocus pocus", "xyz"], "c": ["".join(rng.choices(wide, k=400)), "".join(rng.choices("ab ", k=300))], "d": ["".join(wide)]})
        texts = ["abracadabra", "pocus hocus", "zzz", "q", "", "alakazam cad", "ab" * 200, "".join(rng.choices("abc xyz", k=500)), "".join(rng.choices(wide + list("ab Ж"), k=700)), "".join(wide) * 2, "abra cadabra" * 30]
        coded = [model.classes(langid.points(t)) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
        got = model.phrases(np.concatenate(coded), at)
        for i, lang in enumerate(model.langs):
            sample = ["".join(map(chr, 32 + model.classes(langid.points(t)))) for t in model.samples[lang]]
            assert got[i].tolist() == [slow_phrases("".join(map(chr, 32 + c)), sample) for c in coded], (dense, lang)


def test_language_id_with_many_languages_and_scripts(spark):
    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    rows, vocabulary = [], {}
    for k in range(70):
        vocabulary[k] = ["".join(rng.choices(letters, k=3)) for _ in range(40)]
        rows += [(f"l{k:02d}", " ".join(rng.choices(vocabulary[k], k=30))) for _ in range(4)]
    rows += [("copies", "only this one text")] * 500
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    tests = [(f"l{k:02d}", " ".join(rng.choices(vocabulary[k], k=30))) for k in range(70)] + [("copies", "this one text only")]
    got = langid.predict(spark.createDataFrame(tests, "lang string, text string"), model, kept=("lang",)).collect()
    assert len(model.langs) == 71 and all(r["lang"] == r["lang_pred"] for r in got)


def test_language_id(spark, docs):
    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(all_docs.where(~out))
    held = langid.predict(all_docs.where(out), model, kept=("doc_id", "lang"))
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model, kept=("text",)).collect()}
    assert odd[""] == odd[None] == odd["   "] == ("und", 0.0) and odd["one two"][0] != "und"
    nobody = langid.train(empty(all_docs))
    assert {r["lang_pred"] for r in langid.predict(docs, nobody).collect()} == {"und"}
    assert langid.predict(empty(docs), model).count() == 0


def test_lm_scoring(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = langid.held_out(F.col("doc_id"), 10, 0)
    tokens = [[*words(t), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, log = sum(c.values()), math.log10
    bottom = log(n + 0.1 * (len(c) + 1))
    want = sorted((str(i), h, len(t), sum(c[w] > 0 for w in t), round(sum(log(c[w] + 0.1) - bottom for w in t), 4)) for (i, _), t, h in zip(rows, tokens, held, strict=True))
    got = lm_scoring.score(docs, out).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    assert lm_scoring.score(empty(docs), out).count() == 0


def test_lm_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm_scoring.score(docs, langid.held_out(F.col("doc_id"), 10, 0)).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert rows[0] > 10_000 and rows[2] / rows[0] > rows[1] / rows[0] + 0.01  # log10 a token


def test_lm_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    feats, bias = rng.integers(0, lm_scoring.BUCKETS, (3, 4000)), np.zeros(lm_scoring.CLASSES, np.float32)
    klass = feats[0] % lm_scoring.CLASSES
    w = np.zeros((lm_scoring.BUCKETS, lm_scoring.CLASSES), np.float32)
    before = lm_scoring.log_probabilities(w, bias, feats, klass).mean()
    squares = np.zeros_like(w)
    for _ in range(20):
        lm_scoring.update(w, squares, bias, feats, klass)
    assert lm_scoring.log_probabilities(w, bias, feats, klass).mean() > before + 0.5


def test_lm_table_grows_with_the_training_tokens(spark, docs, monkeypatch):
    assert [lm_scoring.buckets_for(n) for n in (0, 1 << 27, 1 << 28, 60 << 28)] == [1 << 14, 1 << 14, 1 << 15, 60 << 15]
    monkeypatch.setattr(lm_scoring, "TOKENS", 1)
    sizes, real = [], lm_scoring._weights
    monkeypatch.setattr(lm_scoring, "_weights", lambda *args: sizes.append(args[3]) or real(*args))
    assert all(r["score"] < 0 for r in lm_scoring.score(docs, langid.held_out(F.col("doc_id"), 10, 0)).collect())
    assert sizes[0] > 1 << 14


def test_lm_rounds_go_on_from_weights_and_squares_over_all_texts(spark):
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(60)) for i in range(40)]
    bias = np.zeros(lm_scoring.CLASSES, np.float32)
    got, state = lm_scoring._weights(spark.createDataFrame([(t,) for t in texts], "text string").repartition(1), {"w0": 1}, bias, lm_scoring.BUCKETS, 3)
    w, squares = np.zeros((lm_scoring.BUCKETS, lm_scoring.CLASSES), np.float32), np.zeros((lm_scoring.BUCKETS, lm_scoring.CLASSES), np.float32)
    _, _, _, klass, feats, _ = lm_scoring.sequences(pa.array(texts, pa.large_string()), {"w0": 1})
    for _ in range(3):
        lm_scoring.update(w, squares, bias, feats, klass)
    assert np.allclose(got, w, atol=1e-4) and np.allclose(state, squares, rtol=1e-3, atol=1e-4) and np.abs(w).max() > 0.1


def test_lm_score_token_by_token(spark, docs, monkeypatch):
    seen, real = [], lm_scoring._weights
    monkeypatch.setattr(lm_scoring, "_weights", lambda training, top, bias, *rest: seen.append((top, bias, real(training, top, bias, *rest))) or seen[-1][2])
    out = langid.held_out(F.col("doc_id"), 10, 0)
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 2)) for r in lm_scoring.score(docs, out).collect())
    top, bias, (w, _) = seen[0]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    c = collections.Counter(x for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for x in [*words(t), lm_scoring.END])
    n, v = collections.Counter(), collections.Counter()
    for x, k in c.items():
        n[lm_scoring.class_of(x, top)] += k
        v[lm_scoring.class_of(x, top)] += 1
    want = []
    for i, t in rows:
        total, tokens = 0.0, [*words(t), lm_scoring.END]
        _, _, _, _, feats, _ = lm_scoring.sequences(pa.array([t or ""], pa.large_string()), top)
        for x, f in zip(tokens, feats.T, strict=True):
            k, z = lm_scoring.class_of(x, top), w[f].sum(axis=0, dtype=float) + bias
            total += z[k] / math.log(10) - math.log10(np.exp(z).sum()) + math.log10((c[x] + 0.1) / (n[k] + 0.1 * (v[k] + 1)))
        want.append((str(i), len(tokens), total))
    for (i, m, score), (j, tokens, total) in zip(got, sorted((i, m, round(x, 2)) for i, m, x in want), strict=True):
        assert (i, m) == (j, tokens) and math.isclose(score, total, rel_tol=1e-4, abs_tol=0.03)


def test_lm_update_adds_up_repeated_features():
    rng = np.random.default_rng(4)
    size = 70_000  # more than short integers number
    w, bias = rng.normal(size=(size, lm_scoring.CLASSES)).astype(np.float32), np.zeros(lm_scoring.CLASSES, np.float32)
    feats, klass = np.concatenate([rng.integers(0, size, (3, 300)), rng.integers(65_530, 65_545, (3, 300))], axis=1), rng.integers(0, lm_scoring.CLASSES, 600)
    g, total = lm_scoring._softmax(w, bias, feats), np.zeros_like(w)
    g[np.arange(600), klass] -= 1
    for f in feats:
        np.add.at(total, f, g)
    squares = np.ones_like(w)
    want = w - lm_scoring.RATE * total / np.sqrt(1 + total * total + 1e-6)
    lm_scoring.update(w, squares, bias, feats, klass)
    assert np.allclose(w, want, atol=1e-4) and np.allclose(squares, 1 + total * total, rtol=1e-3)


def test_lm_classes_and_hashes_of_words():
    texts = pa.array(["a", "ab", "ba", "the", "é", "日本語", lm_scoring.END, "xthe"], pa.large_string())
    assert lm_scoring.classes_of(texts, {"the": 1, "é": 2}).tolist() == [lm_scoring.class_of(x, {"the": 1, "é": 2}) for x in texts.to_pylist()]
    h = kernels.summed_hashes(texts)
    assert len(set(h.tolist())) == len(texts) and kernels.summed_hashes(texts.slice(2, 3)).tolist() == h[2:5].tolist()


def shingles(text, n):
    w = words(text)
    return frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [])


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("n", "num", "tile"), [(3, 90, 512), (5, 80, 512), (3, 90, 4), (2, 55, 512)])
def test_jaccard_components(spark, n, num, tile, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rng = random.Random(num)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 40, 120, 200]))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.randrange(1, 9)):
            c = list(b)
            for _ in range(rng.randrange(0, max(2, len(c) // 25))):
                c[rng.randrange(len(c))] = f"n{rng.randrange(99)}"
            rows.append((len(rows), " ".join(c)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "one", "one", "One two", " \t"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    sets, root = brute_components(rows, n, num, 100)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked(df, n=n, num=num).collect()}
    assert got == {i: (len(s), least[r]) for (i, _), s, r in zip(rows, sets, root, strict=True)}
    kept = sorted(r["doc_id"] for r in jaccard_join.representatives(df, n=n, num=num).collect())
    assert kept == sorted({least[r] for r in root})


def test_jaccard_links_of_very_different_sizes(spark):
    """At one half, sizes that link lie two bands apart."""
    long = " ".join(f"w{i}" for i in range(22))
    df = spark.createDataFrame([(1, long), (2, " ".join(f"w{i}" for i in range(11))), (3, "w1 w2"), (4, None), (None, "w1 w2"), (None, long + " x"), (None, "other")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.linked(df, n=1, num=50).collect())
    assert got == {(1, 1): 1, (2, 1): 1, (3, 3): 1, (4, 4): 1, (None, 3): 1, (None, 1): 1, (None, None): 1}


def test_pipeline_stages_on_odd_rows(spark, docs):
    """Every stage on nulls, empty and long texts, repeated rows, clashing names and an empty table, against plain Python."""
    clash = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), "n_chars", *(F.lit(i).alias(c) for i, c in enumerate(("base", "extra", "_h", "h", "score", "key", "c0", "digest", "_text", "group", "places"))))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "benchmark", "personal_data", "tokens"]
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for name, stage in stages.items():
        out, none = stage(spark, clash, SF), stage(spark, empty(clash), SF)
        assert none.count() == 0 and none.columns == out.columns
        if name != "tokens":
            assert out.columns == clash.columns and [t for _, t in out.dtypes] == [t for _, t in clash.dtypes]
        if name == "toxicity":
            assert set(rows(out)) <= set(rows(clash)) and out.count() >= 0.9 * clash.count()
        if name == "near_duplicates":
            texts = [(i, r) for i, r in enumerate(clash.collect())]
            _, root = brute_components([(i, r["text"]) for i, r in texts], 5, 80, 100)
            groups = collections.defaultdict(list)
            for (_, r), g in zip(texts, root, strict=True):
                groups[g].append(r)
            want = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
            assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in want)
        if name == "personal_data":
            assert out.where("text LIKE '%a@b.c%' AND doc_id < 1000").count() == 0 and out.where("text LIKE '%<EMAIL>%'").count() > 0
            assert out.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0


def test_jaccard_odd_rows(spark, docs):
    assert jaccard_join.linked(empty(docs)).count() == 0 and jaccard_join.representatives(empty(docs)).count() == 0
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns and kept.where("text = 'one'").count() == 1 and kept.where("text = 'same text here'").count() == 1


def test_toxicity(spark, docs):
    all_docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.train(all_docs, labels.where(~out))
    held = toxicity.scored(all_docs.where(out), model).join(labels, "doc_id").toPandas()
    order = held.score.rank()
    pos = held.toxic == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and held.score.between(0, 1).all()
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.scored(empty(docs), model).count() == 0
    none = toxicity.train(all_docs, labels.where("false"))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}


def test_isotonic_is_the_monotone_fit():
    knots, values = toxicity.isotonic(np.array([1.0, 2, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and np.interp(2.0, knots, values) == pytest.approx(1 / 3) and np.interp(5.0, knots, values) == 1


def test_queries_have_their_columns(spark):
    got = {k: queries.QUERIES[k](spark, SF).columns for k in ("op1_benchmark_decontamination", "op4_pii", "op9_jaccard_join")}
    assert got["op1_benchmark_decontamination"] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got["op4_pii"] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert got["op9_jaccard_join"] == ["doc_id", "n_shingles", "component_id"]
