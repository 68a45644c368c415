"""The ten operators against brute force, and on awkward rows: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest

from llm import chat, components, decontamination, exact_dedup, language_id, packing, secrets, simhash, token_counts, token_files, tokens, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def awkward(spark):
    r = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "Éclair", "naïve", "delta", "token=abcdef123", "x1", "über", "😀smile", "of", "the"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)]
    texts += [None, "", "   \n\t", "123 456 !!!", "ÉCLAIR", "éclair", "ABC def", "abc DEF", "<|endoftext|> a", "a\x00b", "İstanbul", " ".join(r.choice(words) for _ in range(30_000))]
    texts += [texts[0], texts[1], texts[1].upper(), texts[2] + " tail", texts[3] + " tail"]
    data = [(i, t, r.choice(["en", "de", None]), f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    data += [(3, texts[3], "en", "again", 1), (3, texts[3], "en", "again", 1), (None, texts[4], "en", "none", 1), (None, None, None, None, None)]
    # clashing column names
    df = spark.createDataFrame([(*d, 1, b"x", "y", 2, 0.5) for d in data], DOCS + ", row_key int, digest binary, sha string, words int, score double")
    return data, df


def none(df):
    return df.limit(0)


def test_exact_groups(spark, awkward):
    data, df = awkward
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(lower(t), []).append(i)
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(data)
    want = {}
    for i, t, *_ in data:
        own = groups[lower(t)]
        want.setdefault((i, max((x for x in own if x is not None), default=None), len(own), hashlib.sha256(lower(t).encode()).hexdigest()), 0)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == set(want)
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns and sorted(lower(r["text"]) for r in left.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(none(df)).count() == 0 and exact_dedup.deduplicate(none(df)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 100, 5000])
def test_rice_codes(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    k, unary, remainders = exact_dedup.rice_encode(values)
    assert (exact_dedup.rice_decode(len(values), k, unary, remainders) == values).all()
    dense = np.arange(n, dtype=np.uint64)
    assert (exact_dedup.rice_decode(n, *exact_dedup.rice_encode(dense)) == dense).all()


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, awkward):
    data, df = awkward
    short = [(i, t) for i, t, *_ in data if i is not None]
    prints = {(i, t): brute_fingerprint(t) for i, t in short}
    root = union_find([i for i, _ in short], [(a[0], b[0]) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = rows(simhash.near_duplicates(df.where("doc_id is not null")), "doc_id", "fingerprint", "component_id")
    assert got == sorted(((i, f"{prints[i, t]:016x}", root[i]) for i, t in short), key=repr)
    left = simhash.deduplicate(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == sorted(set(root.values()))
    assert simhash.near_duplicates(none(df)).count() == 0 and simhash.deduplicate(none(df)).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_anchor_covering_finds_all_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(150)]
    prints = set(base)
    for b in base[:60]:
        for _ in range(4):
            x = b
            for bit in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << bit
            prints.add(x)
    for b in r.sample(range(1 << 10), 300):  # one group of near copies: points of a ten-bit cube
        prints.add(b << 20)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in rows(links)]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    assert union_find(prints, found) == union_find(prints, [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 3])


def test_word_runs_of_long_texts(monkeypatch):
    data = b" ".join(b"w%d" % (i % 7) for i in range(400))
    whole = simhash.fingerprint(data.decode())
    monkeypatch.setattr(simhash, "RUN_BYTES", 50)
    assert simhash.fingerprint(data.decode()) == whole == brute_fingerprint(data.decode())


@pytest.mark.parametrize("most", [components.ONE_TASK, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "ONE_TASK", most)
    r = random.Random(0)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(200)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = dict(rows(components.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {n: x for n, x in union_find({n for e in edges for n in e}, edges).items() if n in nodes}


def brute_contamination(texts, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    spans = {}
    for item, t in items:
        w = cut(t)
        for i in range(len(w) - min(len(w), window) + 1 if w else 0):
            spans.setdefault(tuple(w[i : i + min(len(w), window)]), set()).add(str(item))
    sizes = {len(s) for s in spans}
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in spans:
                    hit |= set(range(i, i + n))
                    found |= spans[tuple(w[i : i + n])]
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("literals, block", [(50_000, 50_000), (0, 50_000), (0, 40)])
def test_decontamination(spark, awkward, monkeypatch, literals, block):
    monkeypatch.setattr(decontamination, "LITERALS", literals)
    monkeypatch.setattr(decontamination, "SHINGLES_A_PASS", block)
    data, df = awkward
    r = random.Random(1)
    long_text = data[71][1].split()
    items = [(1, " ".join(long_text[50:75])), (2, " ".join(long_text[60:70])), (3, "ÉCLAIR"), (4, ""), (5, None), (6, data[5][1]), (7, "x1, über!"), (10, "of the of the of"), (2, "never seen words here")]
    items += [(20 + i, " ".join(r.choice(long_text) for _ in range(12))) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(df, bench)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(d[0], *w) for d, w in zip(data, brute_contamination([d[1] for d in data], items))]
    assert rows(got, "doc_id", *columns) == sorted(want, key=repr)
    left = decontamination.decontaminate(df, bench)
    assert left.columns == df.columns and left.count() == sum(not w[5] for w in want)
    if block > 40:
        assert decontamination.contamination(none(df), bench).count() == 0
        assert decontamination.contamination(df, none(bench)).where("contaminated or n_items > 0").count() == 0
        assert decontamination.decontaminate(df, none(bench)).count() == len(data)


def test_decontamination_is_native(spark, awkward):
    plan = decontamination.words("text")._jc.toString()
    assert "Python" not in plan
    source = open(decontamination.__file__).read() + open(chat.__file__).read()
    assert not re.search(r"mapInArrow|mapInPandas|applyIn|pandas_udf|\.rdd|F\.udf", source)


def test_secrets(spark, awkward):
    data, df = awkward
    texts = [d[1] for d in data] + ["PassWord = 'abcdef'", "api_key:'xxxxxxx' APIKEY=aaaaaaa", "ſecret=abcdefg ſ secret:abcdefgh", "AKIAKIA" + "A" * 30, "AKIA" + "A" * 15, "a" * 24 + " " + "b" * 23, "😀 token=\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "Bearer  " + "x" * 20, "token:secret=abcdefgh"]
    rules = secrets.BASE + secrets.MORE

    def brute(text):
        return sorted((m.start(), k, m.end()) for k, rule in enumerate(rules) for m in re.finditer(rule.pattern, text or "", re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)) if len(m[rule.group]) >= rule.shortest)

    assert secrets.find(texts) == [brute(t) for t in texts]
    got = secrets.scan(df)
    for r in got.collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(map(":".join, base)).encode()).hexdigest() and r["n_assign"] == sum(s[0] == "assign" for s in base)
    assert rows(got, "doc_id", "spans") == sorted(((d[0], ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in brute(d[1]))) for d in data), key=repr)
    assert secrets.scan(none(df)).count() == 0
    held = {(bytes(r["trigram"]), i) for r in secrets.postings(df.where("doc_id < 70")).collect() for i in r["ids"]}
    assert {(g, i) for i, t, *_ in data if i is not None and i < 70 for g in secrets._prepared(rules)[1].wanted if g in (t or "").encode().lower()} == held


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("abcd") == ("and", frozenset({b"abc", b"bcd"}))
    assert secrets.trigram_query("(abc|xyz)[0-9]+") == ("or", frozenset({b"abc", b"xyz"}))
    assert secrets.trigram_query("(abc|x)?d") is True


def test_warc(spark):
    data = [(5, "http://www.A.com:80/x?b=1#f", "<p>é</p>"), (2, "https://b.a.com", "<p>é</p>"), (7, None, None), (1, "http://a.com/", ""), (9, "http://a.com/\r\nX: y", "p" * 70_000), (8, "http://a.com/2", "p" * 70_000), (None, "u", "<p>é</p>"), (4, "http://a.com/3", "alone"), (4, "http://a.com/3", "alone")]
    pages = spark.createDataFrame([(*d, 1) for d in data], "page_id bigint, url string, html string, sha int")
    for shortest in (0, 5):
        first = {}
        for i, _, h in data:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        got = rows(warc.round_trip(pages, shortest=shortest), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        want = []
        for i, _, h in data:
            payload = (h or "").encode()
            own = len(payload) < shortest or first[h or ""] == i
            want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if own else "revisit", None if own else first[h or ""]))
        assert got == sorted(want, key=repr)
    index = warc.merged_index(warc.write_archives(pages, f"{spark.conf.get('spark.checkpoint.dir')}/w", archive_bytes=100)).orderBy("range", "place").collect()
    keys = [(r["urlkey"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in index]
    assert keys == sorted(keys) and len({r["file"] for r in index}) > 1 and "com,a)/x?b=1" in {r["urlkey"] for r in index}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_of_any_page_id(spark):
    ids = [0, -1, 10**13, 3 * 10**11, -(2**63), 2**63 - 1, -(10**12)]
    pages = spark.createDataFrame([(i, "http://a.com/", f"page {i}") for i in ids], "page_id bigint, url string, html string")
    assert rows(warc.round_trip(pages), "page_id", "record_type") == sorted(((i, "response") for i in ids), key=repr)
    runs = warc.write_archives(pages, f"{spark.conf.get('spark.checkpoint.dir')}/any")
    assert all(re.fullmatch(r"202\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", r["ts"]) for r in runs.collect())


def test_schemas_of_the_contract(spark):
    from llm.queries import QUERIES

    want = {
        "op1_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op3_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
        "op5_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
        "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op8_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
        "op9_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op10_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    }
    for name, columns in want.items():
        got = dict(QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
        assert {c.split()[0]: got[c.split()[0]] for c in columns.split(", ")} == dict(c.split() for c in columns.split(", ")), name


def test_loser_tree():
    r = random.Random(4)
    for k in (0, 1, 2, 3, 7, 8, 70):
        runs = [sorted(r.randint(0, 40) for _ in range(r.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == warc.merge(runs, lambda x: x, most=4) == sorted(sum(runs, []))


def test_packing_plan():
    r = random.Random(7)
    for sizes in ([r.randint(1, 2048) for _ in range(400)], [2048] * 3, [1] * 5000, [1025] * 7 + [1023] * 7, []):
        histogram = {n: sizes.count(n) for n in set(sizes)}
        configs = packing.plan(histogram)
        held = {}
        for config, times in configs:
            assert sum(n * m for n, m in config.items()) <= 2048 and times > 0
            for n, m in config.items():
                held[n] = held.get(n, 0) + m * times
        assert held == histogram
        assert sum(t for _, t in configs) <= max(-(-sum(sizes) // 2048) * 1.12 + 1, 0)


def test_packing(spark, awkward):
    data, df = awkward
    got = packing.pack(df).toPandas()
    tokenizer = tokens.load(packing.TOKENIZER)
    want = []
    for i, t, *_ in data:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()), key=repr) == sorted(want, key=repr)
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(none(df)).count() == 0


def test_language_id(spark):
    r = random.Random(1)
    alphabets = {"aa": ["the", "and", "ing", "tion"], "bb": ["der", "und", "ßen", "ich"]}
    data = [(i, " ".join("".join(r.choice(alphabets[lang]) for _ in range(3)) for _ in range(r.randint(3, 30))), lang) for i in range(200) for lang in [r.choice(["aa", "bb"])]]
    extra = [(1000, None, "aa"), (1001, "", None), (1002, "12 !! 34", "bb"), (None, "the and the", None), (1004, "ICH UND DER" * 9000, None)]
    df = spark.createDataFrame([(*d, 1.0) for d in data + extra], "doc_id bigint, text string, lang string, score double")
    held = language_id.held_out()
    model = language_id.fit(df, ~held)
    got = {r["doc_id"]: r for r in language_id.identify(df, model, held).collect()}
    assert len(got) == len(data) + len(extra) and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in data)
    assert all(got[i]["lang_pred"] == lang for i, _, lang in data) and all(0 <= x["score"] <= 1 for x in got.values())
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(spark.range(300).selectExpr("id AS doc_id", "'a' AS text", "CAST(id AS STRING) AS lang"))
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004]["lang_pred"] == "bb" and got[None]["lang_pred"] == "aa"
    left = language_id.accepted(df, model)
    assert left.columns == df.columns and left.count() == len(data) + 2
    junk = spark.createDataFrame([(2000 + i, " ".join("".join(r.choice(kind) for _ in range(9)) for _ in range(n)), None, 1.0) for i, (kind, n) in enumerate([("bcdfghjklmnpqrstvwxz", 40), ("абвгдежзик", 30), ("qxzjkw", 400)])], df.schema)
    assert language_id.accepted(junk, model).count() == 0 and language_id.accepted(junk, ([], model[1][:, :0])).count() == 3
    assert {x["lang"] for x in language_id.accepted(df, model, frozenset({"aa"})).where("doc_id < 1000").collect()} == {"aa"}
    empty = language_id.fit(none(df))
    assert empty[0] == [] and {r["lang_pred"] for r in language_id.identify(df, empty, held).collect()} == {"und"}
    assert language_id.accepted(df, empty).count() == len(data) + 2 and language_id.accepted(none(df), model).count() == 0


def test_language_scores_do_not_depend_on_blocks(monkeypatch):
    matrix = np.random.default_rng(0).normal(size=(language_id.BUCKETS, 3))
    texts = ["hello world", "", "a", "éè 12 zz", "x", "ÀÉ" * 50]
    together = language_id.scores(texts, matrix)[1]
    assert np.allclose(together, np.vstack([language_id.scores([t], matrix)[1] for t in texts]))
    monkeypatch.setattr(language_id, "GATHERED", 9)
    assert np.allclose(together, language_id.scores(texts, matrix)[1])


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 31, 32])
def test_shards(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    file = io.BytesIO()
    writer = token_files.ShardWriter(file, bits, block_ids=100)
    for doc, (a, b) in {None: (0, 0), 5: (0, 250), -7: (250, 1001)}.items():
        writer.add(doc, ids[a:b].tobytes())
    writer.close()
    reader = token_files.ShardReader(file)
    assert reader.docs == [None, 5, -7] and list(reader.starts) == [0, 0, 250, 1001]
    for a, b in ((0, 1001), (0, 0), (333, 777), (1000, 1001), (99, 101)):
        assert (reader.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError, match="shard"):
        token_files.ShardReader(io.BytesIO(b"x" * 100))


def test_token_files(spark, awkward):
    data, df = awkward
    tokenizer = tokens.load(token_files.TOKENIZER)
    got = token_files.round_trip(df).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d[0] for d in data), key=lambda i: (i is not None, i or 0))
    at, held = 0, {}
    for d in data:
        ids = np.array(tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [2], "<u4")
        held.setdefault(d[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in held[r["doc_id"]]
        at += r["n_tokens"]
    assert token_files.round_trip(none(df)).count() == 0


def test_token_counts_and_cache(spark, awkward):
    data, df = awkward
    tokenizer = tokens.load(token_counts.TOKENIZER)
    cache = f"{spark.conf.get('spark.checkpoint.dir')}/cache-test"
    want = sorted(((d[0], len((d[1] or "").encode()), n, n > 2048) for d in data for n in [len(tokenizer.encode(d[1] or "", add_special_tokens=False).ids)]), key=repr)
    assert rows(token_counts.count_tokens(df.limit(40), cache=cache)) != []
    before = token_counts.cached(spark, cache).count()
    assert rows(token_counts.count_tokens(df, cache=cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    after = token_counts.cached(spark, cache)
    assert after.count() == after.select("digest").distinct().count() == len({d[1] or "" for d in data}) > before
    assert rows(token_counts.count_tokens(df, cache=cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.cached(spark, cache).count() == after.count()
    again = token_counts.cached(spark, cache).collect()
    spark.createDataFrame(again, token_counts.CACHE).write.mode("append").parquet(cache)  # every digest twice
    assert rows(token_counts.count_tokens(df, cache=cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(none(df)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_is_the_library_s(name):
    texts = ["", "don't  DON'T we'll", "a b", "<|endoftext|> hi", "İstanbul ŉ", "x" * 200, "12 ²³ ½", "中文 é", "a \t\n b  ", "\x1c\x85", "é", " ' 's", "''t", "\r\n\r\n x", "tail  "]
    encoder = tokens.Encoder(name)
    for _ in range(2):
        assert list(encoder.encode(texts)) == [encoder._whole(t) for t in texts]


def test_chat(spark):
    data = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> hello  there\n> How are you?\nFine."), (1, 2, "user", "Unrelated"), (1, 3, "user", ">> How are you?\n> Fine.\nGood!\n\nReally"), (1, 4, "assistant", "> really\nyes"), (1, 5, "user", "> nothing known\nx"),
            (2, 0, "user", "> Hello there\nHi"), (2, 1, None, None), (None, 1, "user", "> Hi\nz"), (2, None, "user", "> Hi\nz"), (1, 2, "user", "Unrelated"), (3, 1, "user", "Hi"), (3, 2, "a", ">Hi\n> > Hi")]
    df = spark.createDataFrame([(*d, 1) for d in data], "conv_id bigint, turn bigint, role string, text string, path int")
    out = chat.format_chats(df).collect()
    assert len(out) == len(data)
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["depth"], r["position"], r["text"]) for r in out}
    assert got[1, 1] == (0, 1, 1, "Fine.") and got[1, 3] == (1, 2, 2, "Good!\n\nReally") and got[1, 4] == (3, 3, 3, "yes")
    assert got[1, 5] == (None, 0, 0, "x") and got[2, 0] == (None, 0, 0, "Hi") and got[3, 2] == (1, 1, 1, "") and got[None, 1][0] is None and got[2, None][0] is None
    assert [r["turn"] for r in out if r["conv_id"] == 1] == [0, 1, 3, 4, 2, 2, 5]
    assert next(r["chat"] for r in out if (r["conv_id"], r["turn"]) == (1, 1)) == "<|assistant|>\nFine."
    assert chat.format_chats(none(df)).count() == 0


def test_chat_threads(spark):
    r, parents = random.Random(8), {}
    for c in range(4):
        for t in range(1, 120):
            if r.random() < 0.9:
                parents[c, t * 3 - 200] = (r.choice([0, t - 1, r.randrange(t)])) * 3 - 200
    parents |= {(9, t): 0 for t in range(1, 300)}  # one turn with many answers

    def path(c, t):
        return (path(c, parents[c, t]) if (c, t) in parents else []) + [t]

    paths = {(c, t): path(c, t) for (c, x), up in parents.items() for t in (x, up)}
    thread: dict = {}
    for (c, t), p in sorted(paths.items(), key=lambda x: x[1]):
        thread.setdefault((c, p[0]), []).append(t)
    want = sorted((c, t, parents.get((c, t)), p[0], len(p) - 1, thread[c, p[0]].index(t)) for (c, t), p in paths.items())
    links = spark.createDataFrame([(c, t, up) for (c, t), up in parents.items()], "conv_id bigint, turn bigint, parent_turn bigint").repartition(5)
    assert sorted(map(tuple, chat.threads(links).collect()), key=lambda x: x[:2]) == want


def test_chat_long_thread(spark):
    n = 20_000
    chain = spark.range(1, n).selectExpr("7L AS conv_id", "id AS turn", "id - 1 AS parent_turn")
    got = chat.threads(chain)
    assert got.count() == n and got.where("depth <> turn OR position <> turn OR root_turn <> 0").count() == 0
    assert not [f for f in got.schema if f.dataType.typeName() == "array"]  # no cell grows with the chain


@pytest.mark.parametrize("hot", [4096, 2])
def test_similarity_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(800)]
    texts = [[r.choice(vocabulary) for _ in range(r.randint(100, 400))] for _ in range(60)]
    near = []
    for t in texts[:30]:
        copy = list(t)
        for _ in range(max(1, len(t) // 70)):
            copy[r.randrange(len(t))] = "edited"
        near.append(copy)
    half = [t[: len(t) // 2] + [r.choice(vocabulary) for _ in range(len(t) // 2)] for t in texts[:20]]
    data = [(i, " ".join(t)) for i, t in enumerate(texts + near + half)] + [(500, " ".join(texts[40]) + "\n"), (501, "tiny text"), (502, "tiny text too"), (503, None), (504, "")]
    df = spark.createDataFrame([(*d, 7) for d in data], "doc_id bigint, text string, node int")
    left = {x["doc_id"] for x in simhash.deduplicate(df, similarity=0.8).collect()}
    shingles = {i: {tuple((t or "").lower().split()[j : j + 5]) for j in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for i, t in data}
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    prints = {i: simhash.fingerprint(t) for i, t in data}
    pairs = [(a, b) for a in shingles for b in shingles if a < b and (shingles[a] and shingles[b] and alike(a, b) or (prints[a] ^ prints[b]).bit_count() <= 3)]
    assert left == set(union_find(shingles, pairs).values())
    assert 504 not in left and all(i in left for i in range(90, 110))
    assert simhash.deduplicate(none(df), similarity=0.8).count() == 0


@pytest.mark.parametrize("n", [100, 800, 6000])
def test_representatives_of_a_group_of_copies(spark, n):
    """Pairs handed on for one group of near copies follow its size, and end once all are linked."""
    large = spark.range(n).crossJoin(spark.range(20).withColumnRenamed("id", "token")).selectExpr("token", "id AS node", "100 AS size", "1 AS at", f"{n}L AS members")
    pairs = simhash.by_representatives(large, spark.createDataFrame([], "node bigint, root bigint"), 0, simhash.FIRST, 0.8)
    assert 0 < pairs.distinct().count() <= 3 * 20 * simhash.FIRST * n
    linked = spark.range(n).selectExpr("id AS node", "0L AS root")
    assert simhash.by_representatives(large, linked, 4, 64, 0.8) is None
    two = spark.range(n).selectExpr("id AS node", "IF(id < 5, 0L, 5L) AS root")
    assert simhash.by_representatives(large, two, 0, n, 0.8).distinct().count() == 5 * (n - 5)


def test_profiles_bound_overlaps():
    r = np.random.default_rng(3)
    for n in (0, 3, 500, 200_000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
        b = np.union1d(a[: len(a) // 2], r.integers(0, 1 << 63, n, dtype=np.uint64))
        p, q = (np.frombuffer(simhash.profile(x), np.uint8).astype(int) for x in (a, b))
        assert len(p) == simhash.PROFILE and np.where((p == 255) & (q == 255), 1 << 40, np.minimum(p, q)).sum() >= len(np.intersect1d(a, b))


def test_postings_keep_their_planes():
    r = np.random.default_rng(1)
    rows = np.zeros(77, simhash.POSTING)
    for name in rows.dtype.names:
        rows[name] = r.integers(0, 1 << 31, 77)
    assert (simhash._from_planes(simhash._planes(rows)) == rows).all()


@pytest.mark.parametrize("times", [5, 20, 60])
def test_similarity_dedup_of_repeated_lines(spark, times):
    r = random.Random(times)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    data = []
    for i in range(12):
        text, line = [word() for _ in range(400)], [word() for _ in range(10)]
        data += [(2 * i, " ".join(text[:200] + line + text[200:])), (2 * i + 1, " ".join(text[:200] + line * times + text[200:]))]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert {x["doc_id"] for x in simhash.deduplicate(df, similarity=0.8).collect()} == set(range(0, 24, 2))


@pytest.mark.parametrize("share", [0.8, 0.85])
def test_similarity_dedup_of_contiguous_insertions(spark, share):
    r = random.Random(int(share * 100))
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    data = []
    for i in range(24):
        text = [word() for _ in range(500)]
        at, extra = r.choice([0, 500, r.randrange(500)]), [word() for _ in range(int(492 / share) - 500)]
        data += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:at] + extra + text[at:]))]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert {x["doc_id"] for x in simhash.deduplicate(df, similarity=0.8).collect()} == set(range(0, 48, 2))


@pytest.mark.parametrize("few", [False, True])
def test_similarity_dedup_of_families(spark, monkeypatch, few):
    if few:  # the paths for hot shingles
        for name, n in {"SMALL_GROUP": 2, "GROWTH": 8, "SENT_POSTINGS": 500, "OWNER_POSTINGS": 1000, "HELD_MEMBERS": 5}.items():
            monkeypatch.setattr(simhash, name, n)
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    data = []
    for _ in range(3):
        base = [word() for _ in range(300)]
        for _ in range(60):
            copy = list(base)
            for _ in range(r.randint(2, 9)):
                at = r.randrange(len(copy))
                copy[at : at + r.randint(0, 3)] = [word() for _ in range(r.randint(0, 3))]
            data.append((len(data), " ".join(copy)))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    sets = [set(simhash.distinct_shingles(t, 5).tolist()) for _, t in data]
    prints = [simhash.fingerprint(t) for _, t in data]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 3
    root = union_find(range(len(data)), [(a, b) for a in range(len(data)) for b in range(a) if alike(a, b)])
    assert len(set(root.values())) > 6
    assert {x["doc_id"] for x in simhash.deduplicate(df, similarity=0.8).collect()} == set(root.values())


@pytest.mark.parametrize("pieces", [1000, 20_000, 1_000_000])
def test_packing_program_covers_full_histograms(pieces):
    drawn = np.clip(np.random.default_rng(0).lognormal(6, 1, pieces).astype(int) + 1, 1, 2047)
    lengths, counts = np.unique(drawn, return_counts=True)
    placed = sum(times * sum(int(lengths[i]) * m for i, m in config.items()) for config, times in packing.solve(lengths, counts))
    assert placed >= 0.99 * drawn.sum()
    configs = packing.plan(dict(zip(lengths.tolist(), counts.tolist())))
    assert sum(times for _, times in configs) <= -(-drawn.sum() // 2048) * 1.01 + 1
    assert sum(n * m * times for config, times in configs for n, m in config.items()) == drawn.sum()
